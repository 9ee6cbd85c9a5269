"""Paged web sources as Spark data sources: OData collections and offset link lists.

The pages are fetched through an opener that the session registers with its name; tests and offline runs give one that reads
prepared pages. Pages of one collection follow each other, so a collection is one partition; several are read in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_PAGES = 10_000
Opener = Callable[[str], bytes]


def retrying(opener: Opener, sleep: Callable[[float], None], attempts: int = 5) -> Opener:
    """An opener that waits and tries again, ever longer, on server errors and when it is told to slow down (429)."""

    def fetch(url: str) -> bytes:
        for attempt in range(attempts):
            try:
                return opener(url)
            except OSError as problem:
                code = getattr(problem, "code", None)
                if attempt + 1 == attempts or (code is not None and code != 429 and code < 500):
                    raise
                sleep(min(60.0, 2.0**attempt))
        raise AssertionError

    return fetch


def odata_pages(url: str, opener: Opener) -> Iterator[dict]:
    """All entries of a collection: by its next links, or by $skip as long as a page is full. No page is read twice."""
    seen: set[str] = set()
    while url:
        if url in seen or len(seen) >= MOST_PAGES:
            raise ValueError(f"the pages repeat or don't end: {url}")
        seen.add(url)
        page = json.loads(opener(url))
        entries = page.get("value")
        if not isinstance(entries, list):
            raise ValueError("a page has no value array")
        yield from entries
        link = page.get("@odata.nextLink")
        if not link:
            parts = urlsplit(url)
            query = dict(parse_qsl(parts.query))
            if len(entries) < int(query.get("$top", "250")):
                return
            query["$skip"] = str(int(query.get("$skip", "0")) + len(entries))
            link = urlunsplit(parts._replace(query=urlencode(query), fragment=""))
        url = link


def offset_links(url: str, opener: Opener, find: Callable[[bytes], list[str]], step: int = 10) -> Iterator[str]:
    """Links of an offset list until a page is short; the same file name under two addresses is an error."""
    names: dict[str, str] = {}
    for page in range(MOST_PAGES):
        links = find(opener(f"{url}{'&' if '?' in url else '?'}offset={page * step}"))
        for link in links:
            name = urlsplit(link).path.rpartition("/")[2]
            if names.setdefault(name, link) != link:
                raise ValueError(f"two addresses for {name}")
        if len(links) < step:
            break
    yield from names.values()


class ODataSource(DataSource):
    """spark.read.format(name).option("urls", "one\\ntwo").load(): url and value (the entry as JSON)."""

    opener: Opener

    @classmethod
    def named(cls, source: str, opener: Opener) -> type[ODataSource]:
        """A data source of the given name that reads through the opener; register it with spark.dataSource.register."""
        return type("NamedODataSource", (cls,), {"opener": staticmethod(opener), "name": classmethod(lambda _: source)})

    def schema(self) -> str:
        return "url string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ODataReader(self.options["urls"].split("\n"), type(self).opener)


class _ODataReader(DataSourceReader):
    def __init__(self, urls: list[str], opener: Opener) -> None:
        self.urls, self.opener = urls, opener

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        for entry in odata_pages(partition.value, self.opener):
            yield partition.value, json.dumps(entry, ensure_ascii=False, sort_keys=True)

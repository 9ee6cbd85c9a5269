"""Getting source files: what is missing is fetched in pieces, checked, put in place whole and noted in a manifest."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: opener(url, first, last) -> status, headers (lower case), body; without a range if first is None.
Opener = Callable[[str, int | None, int | None], tuple[int, dict, bytes]]
PIECE = 4 << 20


class Incomplete(OSError):
    """An answer was cut off or wasn't the asked piece."""


def content_range(value: str | None) -> tuple[int, int, int] | None:
    """first, last, total of a Content-Range header; None for other values and unknown totals."""
    found = re.fullmatch(r"bytes\s+(\d+)-(\d+)/(\d+)", value or "", re.I)
    return tuple(map(int, found.groups())) if found else None


def range_parts(header: Column) -> Column:
    """content_range of a column: struct(first, last, total), null for other values."""
    pattern = r"(?i)^bytes\s+(\d+)-(\d+)/(\d+)$"
    part = lambda k: F.regexp_extract(header, pattern, k).cast("bigint")
    return F.when(header.rlike(pattern), F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total")))


def _patient(what: Callable, sleep: Callable[[float], None], attempts: int):
    for attempt in range(attempts):
        try:
            return what()
        except OSError as problem:
            code = getattr(problem, "code", None)
            if attempt + 1 == attempts or (code is not None and code < 500 and code != 429):
                raise
            sleep(min(2.0**attempt, 8.0))
    raise AssertionError


def download(url: str, path: str | Path, opener: Opener, manifest: str | Path, sleep: Callable[[float], None], piece: int = PIECE, attempts: int = 3) -> dict:
    """Fetch a file in ranges if the server can, whole otherwise; returns and notes its manifest entry.

    A failed piece is asked for again at its own place. The file appears under its name only when it is complete.
    """
    if piece < 1 or attempts < 1:
        raise ValueError("pieces and attempts must be positive")
    target, pending = Path(path), Path(f"{path}.tmp")
    target.parent.mkdir(parents=True, exist_ok=True)

    def whole(status: int, headers: dict, body: bytes) -> tuple[int, dict]:
        expected = headers.get("content-length")
        if status != 200 or not body or (expected is not None and int(expected) != len(body)):
            raise Incomplete(f"an incomplete answer for {url}")
        pending.write_bytes(body)
        return status, headers

    def begin() -> tuple[int, dict]:
        status, headers, body = opener(url, 0, 0)
        asked = content_range(headers.get("content-range"))
        if status == 200:
            return whole(status, headers, body)
        if status != 206:
            raise Incomplete(f"status {status} for {url}")
        if asked is None:  # it answers ranges without knowing its length
            return whole(*opener(url, None, None))
        total = asked[2]
        with pending.open("wb") as file:
            for first in range(0, total, piece):
                last = min(first + piece, total) - 1

                def get(first=first, last=last) -> bytes:
                    status, headers, body = opener(url, first, last)
                    if status != 206 or content_range(headers.get("content-range")) != (first, last, total) or len(body) != last - first + 1:
                        raise Incomplete(f"bytes {first}-{last} of {url}")
                    return body

                file.write(_patient(get, sleep, attempts))
        return 206, headers

    try:
        status, headers = _patient(begin, sleep, attempts)
        os.replace(pending, target)
    finally:
        pending.unlink(missing_ok=True)
    data = target.read_bytes()
    entry = {
        "source_url": safe_url(url), "retrieved_at_utc": datetime.now(timezone.utc).isoformat(), "local_path": str(target), "bytes": len(data),
        "sha256": hashlib.sha256(data).hexdigest(), "content_type": headers.get("content-type", ""), "http_status": status,
    }
    note(manifest, entry)
    return entry


def safe_url(url: str) -> str:
    from plenaria.operators.provenance import SENSITIVE

    base, mark, query = url.partition("#")[0].partition("?")
    kept = [p for p in query.split("&") if p and p.partition("=")[0].lower() not in SENSITIVE]
    return base + (f"?{'&'.join(kept)}" if kept else "")


def note(manifest: str | Path, entry: dict) -> None:
    """Append a line; writers of several processes wait for each other."""
    Path(manifest).parent.mkdir(parents=True, exist_ok=True)
    with open(manifest, "a", encoding="utf-8") as file:
        fcntl.flock(file, fcntl.LOCK_EX)
        file.write(json.dumps(entry, ensure_ascii=False, sort_keys=True) + "\n")


def fetch_missing(wanted: DataFrame, present: DataFrame, get: Callable[[str, str], dict] | None = None, parallel: int = 8, connect: Callable[[], Callable[[str, str], dict]] | None = None) -> DataFrame:
    """path, ok, detail of the wanted files (path, url) that aren't present (path). get(url, path) fetches one and returns its entry.

    connect() makes such a getter once for each worker's task, which keeps its connections for all of its files. Only the
    difference is fetched, by at most `parallel` tasks at once; a failure is a row, not the end of the others.
    """
    if (get is None) == (connect is None):
        raise ValueError("give either get or connect")

    def run(batches):
        fetch = get if connect is None else connect()
        for pdf in batches:
            out = []
            for url, path in zip(pdf["url"], pdf["path"], strict=True):
                try:
                    out.append((path, True, fetch(url, path).get("sha256")))
                except OSError as problem:
                    out.append((path, False, str(problem)))
            yield pd.DataFrame(out, columns=["path", "ok", "detail"])

    missing = wanted.join(present.select("path").distinct(), "path", "left_anti").select("url", "path")
    return missing.repartition(parallel).mapInPandas(run, "path string, ok boolean, detail string")


def last_member(exists: Callable[[int], bool], most: int = 4096) -> int:
    """The last number that exists, if all up to it do: doubling, then halving."""
    low, high = 1, 2
    while exists(high):
        low, high = high, high * 2
        if high > most:
            raise ValueError(f"more than {most} members")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(middle) else (low, middle)
    return low


def first_member(value: Callable[[int], int], least: int, last: int) -> int:
    """The first number from 1 whose (never falling) value reaches `least`; last + 1 if none does."""
    low, high = 1, last + 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if value(middle) >= least else (middle + 1, high)
    return low


def sources_of(records: DataFrame, members: DataFrame) -> DataFrame:
    """records (key, source_identifier) with the member of an archive that has them: key, member.

    The part before the colon names the member file; records without such a member are searched for by their identifier.
    """
    stem = F.regexp_extract("member", r"([^/]+)\.[^./]+$", 1)
    named = records.withColumn("_stem", F.substring_index("source_identifier", ":", 1)).where(F.col("source_identifier").contains(":"))
    direct = named.join(members.select(stem.alias("_stem"), "member"), "_stem").groupBy("key").agg(F.min("member").alias("member"))
    rest = records.where(F.coalesce("source_identifier", F.lit("")) != "").join(direct.select("key"), "key", "left_anti")
    # a stated list of few leftovers against all members
    searched = members.join(rest.select("key", "source_identifier"), F.contains(F.decode("content", "utf-8"), F.col("source_identifier")))
    return direct.unionByName(searched.groupBy("key").agg(F.min("member").alias("member")))

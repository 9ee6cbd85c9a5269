"""Queries of the transport operators over prepared pages and files: paged collections, link lists, downloads and tails, each held
against the small dimension tables that the pages are made of."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.functions.text import any_date
from plenaria.operators import quality
from plenaria.runtime import cut, mounted, scratch, table
from plenaria.sources import acquire, files, paged
from plenaria.streaming.tail import GrowingFile, TailCount

QUERIES: dict = {}
SQL: dict[str, str] = {}
SITE = "https://example.invalid"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def entries(spark, d, name: str) -> list[dict]:
    """The rows of a dimension table (fixed size) in order of their key."""
    rows = table(spark, d, name)
    return [r.asDict() for r in rows.orderBy(rows.columns[0]).collect()]


class Pages:
    """A site whose pages are cut out of prepared collections: by next links for one, by $skip for the other."""

    def __init__(self, collections: dict[str, list[dict]], size: int = 4) -> None:
        self.collections, self.size = collections, size

    def __call__(self, url: str) -> bytes:
        parts = urlsplit(url)
        asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
        name = parts.path.strip("/")
        rows, size = self.collections[name], int(asked.get("$top", self.size))
        begin = int(asked.get("$skip", 0))
        page = {"value": rows[begin : begin + size]}
        if "$top" not in asked and begin + size < len(rows):
            page["@odata.nextLink"] = f"{SITE}/{name}?$skip={begin + size}"
        return json.dumps(page).encode()


@query("SELECT 'nation' AS collection, n_nationkey AS \"key\", n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def odata_entries(spark, d):
    """Two paged collections, one by next links, the other by skipping over full pages."""
    pages = Pages({n: entries(spark, d, n) for n in ("nation", "region")})
    spark.dataSource.register(paged.ODataSource.named("prepared_odata", pages))
    read = spark.read.format("prepared_odata").option("urls", f"{SITE}/nation\n{SITE}/region?$top=2").load()
    field = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    return read.select(F.regexp_extract("url", r"invalid/(\w+)", 1).alias("collection"), field("n_nationkey", "r_regionkey").cast("bigint").alias("key"), field("n_name", "r_name").alias("name"))


@query("SELECT 'https://example.invalid/files/' || n_nationkey || '.pdf' AS url FROM nation")
def offset_links(spark, d):
    """A link list of ten links a page, until a page is short."""
    links = [f"{SITE}/files/{r['n_nationkey']}.pdf" for r in entries(spark, d, "nation")]

    def opener(url: str) -> bytes:
        begin = int(parse_qs(urlsplit(url).query)["offset"][0])
        return "\n".join(links[begin : begin + 10]).encode()

    found = paged.offset_links(f"{SITE}/list", paged.retrying(opener, lambda s: None), lambda page: [x for x in page.decode().split("\n") if x])
    return spark.createDataFrame([(x,) for x in found], "url string")


class Site:
    """Files by address, given in ranges."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        self.contents = contents

    def __call__(self, url: str, first: int | None, last: int | None) -> tuple[int, dict, bytes]:
        body = self.contents[url]
        if first is None:
            return 200, {"content-length": str(len(body))}, body
        return 206, {"content-range": f"bytes {first}-{min(last, len(body) - 1)}/{len(body)}", "content-type": "text/plain"}, body[first : last + 1]


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS path, n_nationkey % 5 <> 4 AS ok, CASE WHEN n_nationkey % 5 = 4 THEN 'no file' ELSE sha256(n_name || ': ' || n_name || n_regionkey) END AS detail FROM nation WHERE n_nationkey % 3 <> 0"""
)
def fetched_files(spark, d):
    """Of the wanted files those that aren't there are fetched in pieces by a client of each worker; every fifth can't be had."""
    rows = table(spark, d, "nation")
    text = F.concat("n_name", F.lit(": "), "n_name", F.col("n_regionkey").cast("string"))
    wanted = rows.select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.lit(f"{SITE}/"), "n_nationkey", F.lit("?token=1#"), text).alias("url"))
    present = rows.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("path"))

    with scratch(spark) as place:
        folder = mounted(place)

        def connect():
            sites: dict[str, Site] = {}  # what the client of one worker keeps

            def get(url: str, path: str) -> dict:
                if int(path) % 5 == 4:
                    raise OSError("no file")
                site = sites.setdefault(url, Site({url: url.partition("#")[2].encode()}))
                return acquire.download(url, f"{folder}/{path}", site, f"{folder}/manifest.jsonl", lambda s: None, piece=7)

            return get

        return cut(acquire.fetch_missing(wanted, present, connect=connect))


@query("SELECT n_name AS name, sha256(n_name || n_regionkey) AS sha256, CAST(length(n_name || n_regionkey) AS BIGINT) AS bytes, 'https://example.invalid/' || n_nationkey || '?a=1' AS source_url FROM nation")
def download_manifest(spark, d):
    """The manifest that downloads append to: one entry each, without credentials."""
    rows = entries(spark, d, "nation")
    with scratch(spark) as shared:
        place = mounted(shared)
        for r in rows:
            url = f"{SITE}/{r['n_nationkey']}?a=1&api_key=x#y"
            acquire.download(url, f"{place}/{r['n_name']}", Site({url: f"{r['n_name']}{r['n_regionkey']}".encode()}), f"{place}/manifest.jsonl", lambda s: None, piece=4)
        found = [json.loads(x) for x in Path(place, "manifest.jsonl").read_text(encoding="utf-8").splitlines()]
    return spark.createDataFrame([(Path(e["local_path"]).name, e["sha256"], e["bytes"], e["source_url"]) for e in found], "name string, sha256 string, bytes bigint, source_url string")


@query("SELECT r_regionkey AS region, count(*) AS last, min(n_nationkey) AS least, CAST(count(*) FILTER (WHERE n_nationkey < 10) AS BIGINT) + 1 AS first_from_ten FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def member_search(spark, d):
    """The last member of a numbered series by doubling and halving, and the first one from a value on."""
    series: dict[int, list[int]] = {}
    for r in entries(spark, d, "nation"):
        series.setdefault(r["n_regionkey"], []).append(r["n_nationkey"])
    out = []
    for region, keys in series.items():
        last = acquire.last_member(lambda k, n=len(keys): k <= n)
        out.append((region, last, keys[0], acquire.first_member(lambda k, keys=keys: keys[k - 1], 10, last)))
    return spark.createDataFrame(out, "region bigint, last bigint, least bigint, first_from_ten bigint")


@query("SELECT n_name AS value FROM nation")
def tailed_lines(spark, d):
    """A growing file as a stream: written in two halves, the first ending inside of a line."""
    names = [r["n_name"] for r in entries(spark, d, "nation")]
    whole = "".join(f"{x}\n" for x in names).encode()
    spark.dataSource.register(GrowingFile)
    with scratch(spark) as shared:
        path, tail = Path(mounted(shared), "log.jsonl"), TailCount(r"\w+")
        path.parent.mkdir(parents=True)
        path.write_bytes(b"")

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{shared}/out/{batch}")

        stream = spark.readStream.format("growing_file").option("path", str(path)).load().writeStream.foreachBatch(write).option("checkpointLocation", f"{shared}/state").start()
        for end in (len(whole) // 2, len(whole)):
            path.write_bytes(whole[:end]) if end < len(whole) else path.open("ab").write(whole[len(whole) // 2 :])
            stream.processAllAvailable()
        stream.stop()
        if tail.update(str(path)) != len(names):
            raise AssertionError("the tail counts other lines than there are")
        return cut(spark.read.schema("value string").option("recursiveFileLookup", "true").parquet(f"{shared}/out"))


_DATED = """SELECT DISTINCT coalesce(legislative_term, 'none') AS term, session_id AS proceeding, date AS day, record_status = 'final' AS final FROM speeches WHERE session_id IS NOT NULL AND date IS NOT NULL"""


@query(f"""WITH s AS ({_DATED}), k AS (SELECT term, proceeding, day, coalesce(bool_or(final), false) AS cached FROM s GROUP BY ALL)
    SELECT term, count(*) FILTER (WHERE cached) AS cached_days, count(*) AS target_days FROM k GROUP BY term""")
def progress(spark, d):
    """How many of the sitting days of a term have a final record."""
    rows = table(spark, d, "speeches").where("session_id IS NOT NULL AND date IS NOT NULL")
    days = rows.select(F.coalesce("legislative_term", F.lit("none")).alias("term"), F.col("session_id").alias("proceeding"), F.col("date").alias("day"), "record_status")
    return quality.progress(days.drop("record_status"), days.where("record_status = 'final'"))


@query("SELECT name AS \"key\", value FROM (VALUES ('A', '1'), ('B_C', 'x y'), ('D', 'a=b'), ('E', '')) t(name, value)")
def settings(spark, d):
    """Settings lines: comments, exports, quotes."""
    found = files.load_settings("# no\n\nA=1\nexport B_C='x y'\nD=\"a=b\"\nno line\nE=\n")
    return spark.createDataFrame(sorted(found.items()), "key string, value string")


@query(
    """SELECT DISTINCT l_orderkey % 1000 AS first, l_orderkey % 1000 + l_quantity::BIGINT AS last, l_partkey AS total FROM lineitem"""
)
def content_ranges(spark, d):
    """Content-Range headers taken to pieces."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("a"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_partkey").alias("p")).distinct()
    header = F.format_string("Bytes %d-%d/%d", F.col("a"), F.col("a") + F.col("q"), F.col("p"))
    part = acquire.range_parts(header)
    return rows.select(part["first"].alias("first"), part["last"].alias("last"), part["total"].alias("total")).distinct()


@query(
    r"""SELECT DISTINCT date, strftime(day, '%Y-%m-%d') AS day FROM (SELECT date, coalesce(CASE WHEN regexp_matches(trim(date), '^\d{4}-\d{2}-\d{2}([T ].*)?$') THEN try_cast(substr(trim(date), 1, 10) AS DATE) END,
        CASE WHEN regexp_matches(trim(date), '^\d{4}/\d{1,2}/\d{1,2}$') THEN CAST(try_strptime(trim(date), '%Y/%m/%d') AS DATE) END,
        CASE WHEN regexp_matches(trim(date), '^\d{8}$') THEN CAST(try_strptime(trim(date), '%Y%m%d') AS DATE) END,
        CASE WHEN regexp_matches(trim(date), '^\d{1,2}[./-]\d{1,2}[./-]\d{4}$') THEN CAST(try_strptime(replace(replace(trim(date), '.', '/'), '-', '/'), '%d/%m/%Y') AS DATE) END) AS day FROM speeches)"""
)
def dates_in_all_notations(spark, d):
    rows = table(spark, d, "speeches").select("date").distinct()
    return rows.select("date", F.date_format(any_date(F.col("date")), "yyyy-MM-dd").alias("day"))


@query(
    "SELECT day, strftime(day, '%Y-%m-%d') AS iso FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) UNION ALL SELECT day, strftime(day, '%Y-%m-%d') FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
)
def dates_in_words(spark, d):
    """Days written in Spanish and Italian words, read again."""
    from plenaria.sources import journals as J

    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    name = lambda months: F.get(F.array(*map(F.lit, months)), F.month("day") - 1)
    spanish = F.concat_ws(" ", F.lit("Sesión del"), F.dayofmonth("day").cast("string"), F.lit("de"), name(J.SPANISH_MONTHS), F.lit("de"), F.year("day").cast("string"))
    italian = F.concat_ws(" ", F.lit("Seduta di lunedì"), F.dayofmonth("day").cast("string"), name(J.ITALIAN_MONTHS), F.year("day").cast("string"))
    read = lambda text, pattern, months: days.select("day", J.day_of(text, pattern, months).alias("iso"))
    return read(spanish, J.SPANISH_DAY, J.SPANISH_MONTHS).unionByName(read(italian, J.ITALIAN_DAY, J.ITALIAN_MONTHS))

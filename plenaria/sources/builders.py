"""Country corpora from their raw files, and all of them together.

A builder takes the tables of a country's raw files and gives its speeches, the gaps (path or session, and why), and the
counts. What it reads is relational: which report counts, what a second form of a record fills in, what belongs to the years.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.text import iso_date
from plenaria.operators import corpus, quality
from plenaria.sources import files as F_
from plenaria.sources import parsers

YEARS = (2018, 2026)


@dataclass
class Built:
    """speeches (the speech schema) and gaps (path, failure) of one country."""

    speeches: DataFrame
    gaps: DataFrame

    def counts(self) -> DataFrame:
        """country, records, words, sittings, first_date, last_date: one row."""
        return self.speeches.groupBy("country").agg(
            F.count(F.lit(1)).alias("records"), F.sum("word_count").cast("bigint").alias("words"), F.count_distinct("session_id").alias("sittings"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
        )


def within(speeches: DataFrame, years: tuple[int, int]) -> DataFrame:
    return speeches.where(F.year(iso_date(F.col("date"))).between(*years))


def together(parts: list[tuple[DataFrame, DataFrame]], years: tuple[int, int]) -> Built:
    speeches = reduce(lambda a, b: a.unionByName(b), (s for s, _ in parts))
    return Built(within(speeches, years), reduce(lambda a, b: a.unionByName(b), (g for _, g in parts)))


def france(raw: dict[str, DataFrame], years: tuple[int, int] = YEARS) -> Built:
    """archives: ZIP archives (path, content) of all terms."""
    members = F_.zip_members(raw["archives"], r"/compterendu/.*\.xml$")
    known = F.to_json(F.struct(F.concat("path", F.lit("#"), "member").alias("source_url")))
    return together([parsers.parse_files(members.select(F.concat("path", F.lit("#"), "member").alias("path"), "content", known.alias("known")), "fr_xml")], years)


def germany(raw: dict[str, DataFrame], years: tuple[int, int] = YEARS, doi: str = "", cutoff: str = "2026-09-19") -> Built:
    """archives: ZIP archives of the published table, which ends at the cutoff day; xml: later sitting files."""
    table = F_.german_table(F_.csv_rows(F_.zip_members(raw["archives"], r"\.csv$")), doi, years)
    later, gaps = parsers.parse_files(raw["xml"], "de_xml")
    return together([(table, gaps.limit(0)), (later.where(F.col("date") > cutoff), gaps)], years)


def italy(raw: dict[str, DataFrame], years: tuple[int, int] = YEARS) -> Built:
    """xml and html: sitting files; a sitting's page counts only where its XML gives nothing."""
    first, gaps = parsers.parse_files(raw["xml"], "it_xml")
    second, more = parsers.parse_files(raw["html"], "it_html")
    return together([(parsers.first_usable(first, second), gaps.unionByName(more))], years)


def netherlands(raw: dict[str, DataFrame], years: tuple[int, int] = YEARS) -> Built:
    """meetings with their nested reports, xml: report files whose path holds the report's id. Only the selected reports count."""
    picked = quality.selected_reports(raw["meetings"]).where("report IS NOT NULL").select("report").distinct()
    files = raw["xml"].withColumn("report", F.regexp_extract("path", r"([^/]+)\.xml$", 1)).join(picked, "report", "left_semi")
    speeches, gaps = parsers.parse_files(files, "nl_xml")
    lost = picked.join(raw["xml"].select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("report")), "report", "left_anti")
    return together([(speeches, gaps.unionByName(lost.select(F.col("report").alias("path"), F.lit("report file missing").alias("failure"))))], years)


def spain(raw: dict[str, DataFrame], years: tuple[int, int] = YEARS) -> Built:
    """html: journal pages, lines: positioned lines of journals; a journal's lines count only where its page gives nothing."""
    first, gaps = parsers.parse_files(raw["html"], "es_html")
    second, more = parsers.parse_files(raw["lines"], "es_pdf_lines")
    return together([(parsers.first_usable(first, second), gaps.unionByName(more))], years)


def polish_days(metadata: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements of sitting days in order of their numbers, with `num`, and those without a body.

    metadata: term, proceeding, date, num, name, memberID, function, unspoken, source_url. bodies: term, proceeding, date, num,
    content.
    """
    key = ["term", "proceeding", "date", "num"]
    spoken = metadata.where(~F.coalesce("unspoken", F.lit(False)) & F.col("num").isNotNull())
    place = F.format_string("term-%s/proceeding-%s/%s/statement-%s.html", *[F.col(c).cast("string") for c in key])
    joined = spoken.join(bodies.select(*key, "content"), key, "left").withColumn("path", place)
    known = F.to_json(F.struct(*[c for c in spoken.columns]))
    found, gaps = parsers.parse_files(joined.where("content IS NOT NULL").select("path", "content", known.alias("known")), "pl_html")
    lost = joined.where("content IS NULL").select("path", F.lit("spoken statement body missing").alias("failure"))
    return found.withColumn("num", F.regexp_extract("speech_id", r"-statement(\d+)$", 1).cast("bigint")), gaps.unionByName(lost)


def poland(raw: dict[str, DataFrame], years: tuple[int, int] = YEARS) -> Built:
    """metadata and bodies of statements."""
    found, gaps = polish_days(raw["metadata"], raw["bodies"])
    return together([(found.drop("num"), gaps)], years)


BUILDERS: dict[str, Callable[..., Built]] = {"Germany": germany, "France": france, "Netherlands": netherlands, "Italy": italy, "Spain": spain, "Poland": poland}


def combined(built: dict[str, Built]) -> tuple[DataFrame, dict]:
    """All countries' speeches (each checked to hold its own country only) and the state of the whole: missing cells, gaps, ready."""
    speeches = corpus.union_countries({c: b.speeches for c, b in built.items()})
    missing = quality.missing_coverage(speeches.select("country", iso_date(F.col("date")).alias("day")))
    gaps = {c: [tuple(r) for r in b.gaps.limit(1000).collect()] for c, b in built.items()}
    return speeches, quality.readiness(missing, gaps)


def promote(spark: SparkSession, partial: str, final: str) -> None:
    """Give a whole output its name; one that is there already is an error."""
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    system = path(partial).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.exists(path(final)) or not system.rename(path(partial), path(final)):
        raise OSError(f"{final} is there already or can't be made")


def resume(spark: SparkSession, partial: str, regenerated: DataFrame, final: str) -> int:
    """Finish an output that broke off: its rows (parquet at `partial`, with position) must be the first of the regenerated ones; the
    rest is appended, and the whole is moved to `final`. Returns how many rows were appended.

    A row that differs is an error and nothing is written.
    """
    saved = spark.read.parquet(partial)
    if wrong := quality.same_prefix(saved, regenerated.select(saved.columns)).first():
        raise ValueError(f"the saved output differs from the regenerated one at position {wrong[0]}")
    last = saved.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    rest = regenerated.select(saved.columns).where(F.col("position") > last)
    n = rest.count()
    rest.write.mode("append").parquet(partial)
    promote(spark, partial, final)
    return n

"""Integrity of a corpus: duplicates, defects, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenaria import schema
from plenaria.functions.countries import COUNTRIES
from plenaria.functions.text import iso_date, text_digest, word_count

LONGEST = 10_000


def judged(records: DataFrame) -> DataFrame:
    """records with day, counted, consistent (the stored word count is right), known, sourced, blank and digest."""
    counted = word_count(F.col("speech_text"))
    day = iso_date(F.col("date"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return records.withColumns(
        {
            "day": day,
            "counted": counted,
            "consistent": F.coalesce(F.col("word_count") == counted, F.lit(False)),
            "known": F.coalesce(F.col("country").isin(*COUNTRIES), F.lit(False)),
            "sourced": has("speech_id") & has("source_url") & has("source_identifier"),
            "blank": F.trim(F.coalesce("speech_text", F.lit(""))) == "",
            "digest": text_digest(F.coalesce("speech_text", F.lit(""))),
        }
    )


def audit(records: DataFrame, years: tuple[int, int] = (2018, 2026)) -> DataFrame:
    """One row: records, words, empty_speeches, implausible_lengths, wrong_counts, wrong_countries, wrong_dates, unsourced,
    outside_years, duplicate_speech_id_count, duplicate_text_count, valid.

    Ids count as duplicates among sourced rows only, texts and words only where the stored count is right. Texts are looked at
    once: each row gives its figures under its id and under its text's digest, and both keys are pre-aggregated together.
    """
    rows = judged(records)
    figures = {
        "records": F.lit(1), "words": F.when(F.col("consistent"), F.col("counted")), "empty_speeches": F.col("blank").cast("int"),
        "implausible_lengths": (F.col("consistent") & (F.col("counted") > LONGEST)).cast("int"), "wrong_counts": (~F.col("consistent")).cast("int"),
        "wrong_countries": (~F.col("known")).cast("int"), "wrong_dates": F.col("day").isNull().cast("int"), "unsourced": (~F.col("sourced")).cast("int"),
        "outside_years": (~F.year("day").between(*years)).cast("int"),
    }
    surplus = {"id": "duplicate_speech_id_count", "text": "duplicate_text_count"}
    zero = [F.lit(0).cast("bigint").alias(n) for n in figures]
    own = [F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in figures.items()]
    keyed = F.array(
        F.struct(F.lit("id").alias("kind"), F.when(F.col("sourced"), F.xxhash64("speech_id")).alias("a"), F.when(F.col("sourced"), F.hash("speech_id")).alias("b"), *own),
        F.struct(F.lit("text").alias("kind"), F.when(F.col("consistent"), F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")).alias("a"), F.when(F.col("consistent"), F.conv(F.substring("digest", 16, 7), 16, 10).cast("int")).alias("b"), *zero),
    )
    # keys are known by 96 bits of their hash, so that the aggregation has fixed-width rows only
    per_key = rows.select(F.inline(keyed)).groupBy("kind", "a", "b").agg(*[F.sum(n).alias(n) for n in figures], F.count(F.lit(1)).alias("_n"))
    again = [F.coalesce(F.sum(F.when((F.col("kind") == k) & F.col("a").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias(n) for k, n in surplus.items()]
    out = per_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in figures], *again)
    bad = F.col("wrong_counts") + F.col("wrong_countries") + F.col("wrong_dates") + F.col("unsourced") + F.col("empty_speeches") + F.col("duplicate_speech_id_count")
    return out.withColumn("valid", bad == 0)


def warnings(records: DataFrame, years: tuple[int, int] = (2018, 2026), most: int | None = None) -> DataFrame:
    """speech_id, warning of rows whose day lies outside the years; the first `most` by id and day, if that is given."""
    day = iso_date(F.col("date"))
    rows = records.withColumn("_day", day).where(~F.year("_day").between(*years))
    found = rows.select("speech_id", F.concat(F.lit("date outside configured study years: "), F.date_format("_day", "yyyy-MM-dd")).alias("warning"))
    return found if most is None else found.orderBy("speech_id", "warning").limit(most)


def status_counts(rows: DataFrame, by: list[str], status: str, states: tuple[str, ...]) -> DataFrame:
    """Rows by group, a column for each state and `other` for all else."""
    one = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    other = F.count(F.lit(1)) - F.count_if(F.coalesce(F.col(status).isin(*states), F.lit(False)))
    return rows.groupBy(*by).agg(*[one(F.col(status) == s, s) for s in states], other.alias("other"))


def defects(records: DataFrame) -> DataFrame:
    """One row per defect: speech_id, defect."""
    rows = judged(records)
    tests: dict[str, Column] = {
        "unexpected country": ~F.col("known"),
        "missing ID or provenance": ~F.col("sourced"),
        "invalid date": F.col("day").isNull(),
        "empty text": F.col("blank"),
        "inconsistent word count": ~F.col("consistent"),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return rows.select("speech_id", F.explode(found).alias("defect"))


def first_errors(records: DataFrame, most: int = 1000) -> list[str]:
    """Messages of at most `most` defects in order of the ids; more of them is an error, as for a corpus beyond repair."""
    rows = defects(records).orderBy("speech_id", "defect").limit(most + 1).collect()
    messages = [f"record {r.speech_id}: {r.defect}" for r in rows]
    if len(messages) > most:
        raise ValueError("too many corpus integrity errors; first: " + "; ".join(messages[:5]))
    return messages


def duplicate_ids(records: DataFrame, order: str = "delivered_at", first: int = 20) -> DataFrame:
    """The first ids that were delivered again, by time of the repetition: speech_id, times."""
    rows = judged(records).where("sourced").groupBy("speech_id").agg(F.count(F.lit(1)).alias("times"), F.max(order).alias("_at")).where("times > 1")
    return rows.orderBy("_at", "speech_id").limit(first).select("speech_id", "times")


def repeated_texts(records: DataFrame) -> DataFrame:
    """digest, rows of normalised texts that occur more than once in consistent rows."""
    rows = judged(records).where("consistent").groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    return rows.where("rows > 1")


def country_years(rows: DataFrame) -> DataFrame:
    """country, year, records. rows: country, day."""
    return rows.where("day IS NOT NULL").groupBy("country", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("records"))


def missing_coverage(rows: DataFrame, countries: tuple[str, ...] = COUNTRIES, years: tuple[int, int] = schema.YEARS) -> DataFrame:
    """Countries and years without any row."""
    span = rows.sparkSession.range(years[0], years[1] + 1, numPartitions=1).select(F.col("id").cast("int").alias("year"))
    grid = span.select("year", F.explode(F.array(*map(F.lit, countries))).alias("country")).select("country", "year")
    seen = rows.where("day IS NOT NULL").select("country", F.year("day").alias("year")).distinct()
    return F.broadcast(grid).join(seen, ["country", "year"], "left_anti")


#: Numbers of one window of number_gaps.
SPAN = 1 << 16


def number_gaps(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of numbers missing between a group's least and greatest: group, first_missing, last_missing.

    By the distance to the next number, so no range is ever laid out. The windows are of SPAN numbers each, whatever a group
    holds; between them only their ends are compared.
    """
    numbers = rows.where(F.col(number).isNotNull()).select(*group, F.col(number).cast("bigint").alias("_n"), F.floor(F.col(number) / SPAN).alias("_span")).distinct()
    inside = numbers.select(*group, "_n", F.lead("_n").over(Window.partitionBy(*group, "_span").orderBy("_n")).alias("_next"))
    ends = numbers.groupBy(*group, "_span").agg(F.min("_n").alias("_least"), F.max("_n").alias("_n"))
    between = ends.select(*group, "_n", F.lead("_least").over(Window.partitionBy(*group).orderBy("_span")).alias("_next"))
    gaps = inside.unionByName(between).where(F.col("_next") > F.col("_n") + 1)
    return gaps.select(*group, (F.col("_n") + 1).alias("first_missing"), (F.col("_next") - 1).alias("last_missing"))


def number_coverage(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """group, present, least, greatest, expected, missing."""
    sums = rows.where(F.col(number).isNotNull()).groupBy(*group).agg(F.count_distinct(number).alias("present"), F.min(number).alias("least"), F.max(number).alias("greatest"))
    expected = (F.col("greatest") - F.col("least") + 1).cast("bigint")
    return sums.withColumns({"expected": expected, "missing": expected - F.col("present")})


def same_prefix(saved: DataFrame, regenerated: DataFrame, position: str = "position") -> DataFrame:
    """Positions at which a saved output differs from the regenerated one: position. None: the saved rows are a prefix."""
    columns = [c for c in saved.columns if c != position]
    a = saved.select(position, F.struct(*columns).alias("_a"))
    b = regenerated.select(position, F.struct(*columns).alias("_b"))
    return a.join(b, position, "left").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(position)


def readiness(missing: DataFrame, gaps: dict[str, list | None]) -> dict:
    """Whether a build is complete: blockers of missing coverage and of gap reports (None: the report itself is missing).

    The open gaps of Germany are information, not a blocker.
    """
    open_cells = [f"{r.country}:{r.year}" for r in missing.orderBy("country", "year").collect()]
    blockers = [f"no records for {x}" for x in open_cells]
    for country, found in sorted(gaps.items()):
        if found is None:
            blockers.append(f"gap report of {country} is missing")
        elif found and country != "Germany":
            blockers.append(f"{len(found)} unresolved gaps of {country}")
    return {"missing_coverage": open_cells, "blockers": blockers, "ready": not blockers}


def meeting_coverage(meetings: DataFrame) -> DataFrame:
    """listed, selected, provisional_only, without of meetings with nested reports, by year.

    meetings: Id, Datum, Verslag (array of Id, Soort, Status, GewijzigdOp, Verwijderd). The latest final report in a corrected
    state that isn't deleted counts.
    """
    picked = selected_reports(meetings)
    return picked.groupBy(F.substring("Datum", 1, 4).alias("year")).agg(
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("report").isNotNull()).alias("selected"),
        F.count_if(F.col("report").isNull() & F.col("provisional").isNotNull()).alias("provisional_only"), F.count_if(~F.coalesce("any_report", F.lit(False))).alias("without"),
    )


# Kinds and states of Dutch reports.
FINAL_STATES = ("Gecorrigeerd", "Gerectificeerd")
FINAL_KIND, PROVISIONAL_KIND = "Eindpublicatie", "Tussenpublicatie"


def selected_reports(meetings: DataFrame) -> DataFrame:
    """meetings with report and provisional (the ids of the latest ones, or null) and any_report."""
    alive = F.filter(F.coalesce("Verslag", F.array()), lambda v: ~F.coalesce(v["Verwijderd"], F.lit(False)))
    latest = lambda test: F.array_max(F.transform(F.filter(alive, test), lambda v: F.struct(v["GewijzigdOp"].alias("at"), v["Id"].alias("Id"))))["Id"]
    final = latest(lambda v: v["Status"].isin(*FINAL_STATES) & (v["Soort"] == FINAL_KIND))
    return meetings.withColumns({"report": final, "provisional": latest(lambda v: v["Soort"] == PROVISIONAL_KIND), "any_report": F.size("Verslag") > 0})


def meeting_details(meetings: DataFrame) -> DataFrame:
    """The meetings without a final report in order of date and id: Datum, Id, provisional (the id of its latest provisional
    report, or null), any_report."""
    picked = selected_reports(meetings).where("report IS NULL")
    return picked.orderBy("Datum", "Id").select("Datum", "Id", "provisional", F.coalesce("any_report", F.lit(False)).alias("any_report"))


def wanted_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted statements without a file: index (path and other columns) minus files (path)."""
    return index.join(files.select("path").distinct(), "path", "left_anti")


def statement_coverage(days: DataFrame, metadata: DataFrame, bodies: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Coverage of indexed sitting days by statement lists and bodies: a row per term, and the missing items with their reason.

    days: term, proceeding, day (what the index says); metadata: term, proceeding, day, document (the text of the list's file:
    JSON with an array `statements` of objects with num and maybe unspoken); bodies: term, proceeding, day, num; terms: the
    terms that an index is wanted of.
    """
    key = ["term", "proceeding", "day"]
    nothing = F.lit(None).cast("bigint")
    seen = days.select(*key).distinct().join(metadata.select(*key, "document", F.lit(True).alias("_there")), key, "left")
    listed = F.get_json_object("document", "$.statements")
    variant = F.try_parse_json("document")
    kind = F.schema_of_variant(F.try_variant_get(variant, "$.statements", "variant"))
    state = (
        F.when(F.col("_there").isNull(), "statement metadata missing").when(variant.isNull() | listed.isNull() & kind.isNull(), "invalid statement metadata").when(~F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)), "statement list is not an array")
    )
    judged = seen.select(*key, state.alias("reason"), listed.alias("listed"))
    each = judged.where("reason IS NULL").select(*key, F.explode(F.from_json("listed", "array<string>")).alias("s"))
    is_object = F.startswith(F.ltrim(F.coalesce("s", F.lit(""))), F.lit("{"))
    items = each.select(*key, is_object.alias("is_object"), F.get_json_object("s", "$.num").alias("text"), F.coalesce(F.get_json_object("s", "$.unspoken") == "true", F.lit(False)).alias("unspoken"))
    number = F.when(F.trim("text").rlike(r"^[+-]?\d+$"), F.trim("text").try_cast("bigint"))
    spoken = items.where("is_object AND NOT unspoken").select(*key, number.alias("num"))
    absent = spoken.where("num IS NOT NULL").join(bodies.select(*key, F.col("num").cast("bigint").alias("num")).distinct(), [*key, "num"], "left_anti")
    missing = (
        judged.where("reason IS NOT NULL").select(*key, nothing.alias("num"), "reason")
        .unionByName(items.where("NOT is_object").select(*key, nothing.alias("num"), F.lit("statement metadata is not an object").alias("reason")))
        .unionByName(spoken.where("num IS NULL").select(*key, "num", F.lit("invalid statement number").alias("reason")))
        .unionByName(absent.select(*key, "num", F.lit("spoken statement body missing").alias("reason")))
    )
    if terms is not None:
        gone = terms.select("term").distinct().join(days.select("term"), "term", "left_anti")
        missing = missing.unionByName(gone.select("term", nothing.alias("proceeding"), F.lit(None).cast(dict(days.dtypes)["day"]).alias("day"), nothing.alias("num"), F.lit("proceedings index missing").alias("reason")))
    sums = days.groupBy("term").agg(F.count_distinct("proceeding").alias("proceedings"), F.count_distinct("proceeding", "day").alias("target_dates"), F.min("day").alias("first_date"), F.max("day").alias("last_date"))
    expected = spoken.groupBy("term").agg(F.count(F.lit(1)).alias("expected_spoken_bodies"))
    lists = metadata.groupBy("term").agg(F.count(F.lit(1)).alias("statement_metadata_files"))
    found = bodies.groupBy("term").agg(F.count(F.lit(1)).alias("statement_body_files"))
    report = sums.join(expected, "term", "left").join(lists, "term", "left").join(found, "term", "left")
    return report.fillna(0, ["expected_spoken_bodies", "statement_metadata_files", "statement_body_files"]), missing


def progress(days: DataFrame, cached: DataFrame) -> DataFrame:
    """Per term how many of its target days (term, proceeding, day) are cached."""
    marked = days.distinct().join(cached.select("term", "proceeding", "day", F.lit(1).alias("_c")).distinct(), ["term", "proceeding", "day"], "left")
    return marked.groupBy("term").agg(F.count("_c").alias("cached_days"), F.count(F.lit(1)).alias("target_days"))


def one_address(links: DataFrame) -> DataFrame:
    """name, url of a link list; a name under two addresses is an error when it is read."""
    grouped = links.groupBy("name").agg(F.min("url").alias("url"), F.max("url").alias("_other"))
    wrong = F.raise_error(F.concat(F.lit("two addresses for "), "name"))
    return grouped.select("name", F.when(F.col("url") == F.col("_other"), F.col("url")).otherwise(wrong).alias("url"))


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: count and sums of two hashes of every row."""
    columns = sorted(df.columns)
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    r = df.agg(F.count(F.lit(1)).alias("n"), wide(1).alias("a"), wide(2).alias("b")).first()
    return f"{r.n}:{r.a or 0}:{r.b or 0}"

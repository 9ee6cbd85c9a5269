"""Detector responses and the shares that they give to speeches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.text import label_class


def fraction(value: Column, name: str) -> Column:
    """A fraction, 0 for null; outside of [0, 1] it is an error."""
    plain = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))
    return F.when((plain >= 0) & (plain <= 1), plain).otherwise(F.raise_error(F.lit(f"{name} must be between 0 and 1")))


def response_problem(allowed: tuple[str, ...] | None = None) -> Column:
    """What is wrong with a complete response, null if nothing is or if it isn't complete: a fraction that is none or lies outside
    of [0, 1], fractions that add up to more than 1, a version that isn't among the allowed ones."""
    names = ("fraction_ai", "fraction_ai_assisted", "fraction_human")
    wrong = F.when(F.lit(False), "")
    for n in names:
        wrong = wrong.when(F.col(n).isNull() | F.isnan(n) | ~F.col(n).between(0, 1), f"invalid {n}")
    wrong = wrong.when(F.col(names[0]) + F.col(names[1]) + F.col(names[2]) > 1.00001, "fractions sum to more than 1")
    if allowed is not None:
        wrong = wrong.when(~F.coalesce(F.col("version").isin(*allowed), F.lit(False)), "version isn't entitled")
    return F.when((F.col("stage") == "complete") & F.col("error").isNull(), wrong)


def shares(ai: Column, mixed: Column, windows: Column) -> Column:
    """struct(ai, mixed) of a response.

    Windows with only known labels and with words say more than the fractions of the whole; a negative word count is an
    error, and so are fractions that add up to more than 1. The windows are folded in place, without explode or shuffle.
    """
    a, m = fraction(ai, "fraction_ai"), fraction(mixed, "fraction_ai_assisted")
    a = F.when(a + m <= 1.000001, a).otherwise(F.raise_error(F.lit("the fractions of a response exceed 1")))
    seen = F.coalesce(windows, F.array().cast("array<struct<label:string,word_count:int>>"))

    def words(kind: str | None) -> Column:
        chosen = seen if kind is None else F.filter(seen, lambda w: label_class(w["label"]) == kind)
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, w: n + F.coalesce(w["word_count"], F.lit(0)).cast("bigint"))

    negative = F.exists(seen, lambda w: F.coalesce(w["word_count"], F.lit(0)) < 0)
    unknown = F.exists(seen, lambda w: label_class(w["label"]) == "unknown")
    total = F.when(negative, F.raise_error(F.lit("negative window word count")).cast("bigint")).otherwise(words(None))
    use = ~unknown & (total > 0)
    pick = lambda kind, whole: F.when(use, F.try_divide(words(kind).cast("double"), total.cast("double"))).otherwise(whole)
    return F.struct(pick("ai", a).alias("ai"), pick("mixed", m).alias("mixed"))


def latest_responses(responses: DataFrame) -> DataFrame:
    """speech_id, ai, mixed of the latest complete response of each speech; errors and pending ones don't count.

    Equal times are settled by the values, so exact duplicates don't matter. Combined on the map side.
    """
    usable = responses.where((F.col("stage") == "complete") & F.col("error").isNull() & F.col("speech_id").isNotNull() & F.col("fraction_ai").isNotNull() & F.col("fraction_ai_assisted").isNotNull())
    rated = usable.select("speech_id", "scored_at", shares(F.col("fraction_ai"), F.col("fraction_ai_assisted"), F.col("windows")).alias("s"))
    best = rated.groupBy("speech_id").agg(F.max(F.struct("scored_at", "s.ai", "s.mixed")).alias("r"))
    return best.select("speech_id", F.col("r.ai").alias("ai"), F.col("r.mixed").alias("mixed"))


def mock_shares(speech_id: Column) -> Column:
    """struct(ai, mixed) that a pretended detector gives to a speech: the first digest bytes of its id, in hundredths."""
    byte = lambda p: F.conv(F.substring(F.sha2(speech_id, 256), p, 2), 16, 10).cast("bigint")
    return F.struct((F.pmod(byte(1), F.lit(16)) / F.lit(100.0)).alias("ai"), (F.pmod(byte(3), F.lit(11)) / F.lit(100.0)).alias("mixed"))


Source = DataFrame | Column | Callable[[DataFrame], DataFrame]


def score(rows: DataFrame, source: Source, must_match: bool = False) -> DataFrame:
    """rows with ai and mixed from responses (a table by speech_id), a struct column, or a function of the rows.

    Filter before scoring: only the given rows are scored. Rows without a response are left out, or an error if must_match.
    """
    if isinstance(source, Column):
        return rows.withColumn("_s", source).withColumns({"ai": F.col("_s.ai"), "mixed": F.col("_s.mixed")}).drop("_s")
    if not isinstance(source, DataFrame):
        return source(rows)
    if not must_match:
        return rows.join(source.select("speech_id", "ai", "mixed"), "speech_id")
    joined = rows.join(source.select("speech_id", "ai", "mixed"), "speech_id", "left")
    missing = F.raise_error(F.concat(F.lit("no response for "), F.col("speech_id"))).cast("double")
    return joined.withColumn("ai", F.coalesce("ai", missing))

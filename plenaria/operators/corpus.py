"""The corpus: one typed row per speech from the delivered records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.functions.countries import COUNTRIES, country_name
from plenaria.functions.deliveries import first_delivery
from plenaria.functions.text import any_date, word_count

#: Columns of the corpus that are made of several or changed ones.
MADE = {
    "country": lambda: country_name(F.col("country")),
    "day": lambda: any_date(F.col("date")),
    "words": lambda: word_count(F.col("speech_text")),
    "digest": lambda: F.sha2("speech_text", 256),
}


def corpus(speeches: DataFrame, *columns: str) -> DataFrame:
    """speech_id and the wanted columns of each speech's first delivery: any stored column, or day, words, digest.

    Words and digests are made before the shuffle, so a text is only moved if it is asked for itself.
    """
    return first_delivery(speeches, {c: MADE[c]() if c in MADE else F.col(c) for c in columns})


def dimension(spark) -> DataFrame:
    """The countries in their fixed order: country, place."""
    return spark.createDataFrame(list(zip(COUNTRIES, range(len(COUNTRIES)), strict=True)), "country string, place int")


def union_countries(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of country tables; a row of another country than its table's is an error when it is read."""

    def checked(country: str, df: DataFrame) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit(f"a row of {country} says "), F.coalesce("country", F.lit("null"))))
        return df.withColumn("country", F.when(F.col("country") == country, F.col("country")).otherwise(wrong))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (checked(c, d) for c, d in parts.items()))


def filtered(rows: DataFrame, country: str | None = None, years: list[int] | None = None, period: str | None = None, min_words: int = 40) -> DataFrame:
    """Rows (country, day, words) of a country, of years and of a period ('historical': to 2021, 'post': from 2023) with enough
    words. A row without a valid date drops out only if a date is asked about."""
    rows = rows.where(F.col("words") >= min_words)
    if country:
        rows = rows.where(F.col("country") == country)
    if years:
        rows = rows.where(F.year("day").isin(*years))
    if period == "historical":
        rows = rows.where(F.year("day") <= 2021)
    elif period == "post":
        rows = rows.where(F.year("day") >= 2023)
    elif period:
        raise ValueError("period must be historical or post")
    return rows

"""What scoring a corpus costs."""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.text import units

TOTAL = "TOTAL"


def estimate_cost(rows: DataFrame, price: float = 0.5, block: int = 100) -> DataFrame:
    """One row per country and a TOTAL: country, speeches, words, estimated_api_units, estimated_cost.

    A speech is charged by begun blocks of words at `price` per 1,000 words. rows: country, words. One pass by rollup.
    """
    if price < 0 or block < 1:
        raise ValueError("the price must not be negative and a block must have a word")
    sums = rows.rollup("country").agg(
        F.grouping("country").alias("_total"),
        F.count(F.lit(1)).alias("speeches"),
        F.coalesce(F.sum("words").cast("bigint"), F.lit(0)).alias("words"),
        F.coalesce(F.sum(units(F.col("words"), block)), F.lit(0)).alias("estimated_api_units"),
    )
    named = sums.withColumn("country", F.when(F.col("_total") == 1, TOTAL).otherwise(F.col("country"))).drop("_total")
    # an empty table has a total too
    none = rows.sparkSession.range(1).select(F.lit(TOTAL).alias("country"), *[F.lit(0).cast("bigint").alias(c) for c in ("speeches", "words", "estimated_api_units")])
    every = named.unionByName(none).groupBy("country").agg(*[F.sum(c).alias(c) for c in ("speeches", "words", "estimated_api_units")])
    return every.withColumn("estimated_cost", F.col("estimated_api_units") * F.lit(float(block)) * F.lit(float(price)) / F.lit(1000.0))


def affordable_units(budget: float, price: float) -> int:
    """Blocks of 100 words that a budget covers, in exact decimals and never rounded up."""
    if budget < 0 or price <= 0:
        raise ValueError("a budget must not be negative and a price must be positive")
    return int((Decimal(str(budget)) / (Decimal(str(price)) / 10)).to_integral_value(ROUND_FLOOR))


def units_within(budget: Column, price: Column) -> Column:
    """affordable_units of columns: exact decimals, rounded down; null for a price that isn't positive."""
    exact = lambda c: c.cast("decimal(20,4)")
    return F.when(price > 0, F.floor(exact(budget) * 10 / exact(price)).cast("bigint"))


def within_cap(cost: float, controls: float, cap: float) -> bool:
    """Whether the speeches and the controls together stay within the cap, in exact decimals."""
    return Decimal(str(cost)) + Decimal(str(controls)) <= Decimal(str(cap))

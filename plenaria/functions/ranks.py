"""Exact prefixes of a hash order, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a digest that give its place in the unit interval.
DIGITS = 13
#: Steps of the histogram over the unit interval.
STEPS = 4096


def unit_hash(salt: str, *parts: Column) -> Column:
    """Place of a key in [0, 1): the first 52 bits of the SHA-256 of salt and key. The same on any engine and partitioning."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def hash_prefix(df: DataFrame, group: list[str], unit: str, size: Column, budget: str, tie: str) -> DataFrame:
    """Rows of each group in the order of (unit, tie) as long as the sum of size stays within the group's budget.

    unit is in [0, 1); budget is a column of df that is equal within a group. A histogram of the sizes over the unit
    interval (aggregated on the map side, at most STEPS rows a group) finds the step in which the budget ends. Rows of
    earlier steps are taken as they are; only the rows of that one step are ordered. So no task ever holds a whole group,
    and the result is exactly the sorted prefix: the first row that passes the budget ends it.
    """
    stepped = df.withColumn("_size", size.cast("double")).withColumn("_step", F.floor(F.col(unit) * STEPS).cast("int"))
    sums = stepped.groupBy(*group, "_step").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_step")
    sums = sums.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum")).drop("_sum")
    placed = stepped.join(sums, [*group, "_step"])
    ends = F.col("_before") > F.col(budget)
    within = placed.where(~ends)
    tail = sums.groupBy(*group, "_step").agg(F.first("_before").alias("_start"))
    after = Window.partitionBy(*group).orderBy("_step")
    tail = tail.select(*group, "_step", F.lead("_start").over(after).alias("_end"))
    within = within.join(tail, [*group, "_step"])
    whole = within.where(F.col("_end") <= F.col(budget))
    last = within.where(F.col("_end").isNull() | (F.col("_end") > F.col(budget)))
    run = Window.partitionBy(*group, "_step").orderBy(unit, tie)
    last = last.withColumn("_run", F.sum("_size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where(F.col("_before") + F.col("_run") <= F.col(budget)).drop("_run")
    return whole.unionByName(last).drop("_size", "_step", "_before", "_end")

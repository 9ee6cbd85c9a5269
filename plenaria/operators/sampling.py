"""Reproducible samples: by stratum and budget, by quota with speaker caps, for review and for tests."""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenaria import schema
from plenaria.functions.ranks import hash_prefix
from plenaria.functions.text import known_id, length_band, units
from plenaria.operators.cost import affordable_units
from plenaria.runtime import cut

SEED = 2026


def priority(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, as hex: it sorts like the number."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def positioned(sample: DataFrame, order: list[str]) -> DataFrame:
    """A sample with position (from 1) in an order.

    The rows are sorted by range partitioning; positions come from the partitions' sizes, so no task holds them all.
    """
    sorted_ = cut(sample.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_least"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", "_least", F.coalesce(before, F.lit(0)).alias("_before"))
    return sorted_.join(F.broadcast(starts), "_p").withColumn("position", F.col("_before") + F.col("_i") - F.col("_least") + 1).drop("_p", "_i", "_least", "_before")


def stratum(country: Column, day: Column) -> Column:
    return F.concat(country, F.lit(":"), F.date_format(day, "yyyy-MM"))


def strata(rows: DataFrame, min_words: int = 40) -> DataFrame:
    """stratum, eligible, max_units, total_units of country months. rows: country, day, words."""
    kept = rows.where((F.col("words") >= min_words) & F.col("day").isNotNull())
    u = units(F.col("words"))
    return kept.groupBy(stratum(F.col("country"), F.col("day")).alias("stratum")).agg(F.count(F.lit(1)).alias("eligible"), F.max(u).alias("max_units"), F.sum(u).alias("total_units"))


def allocate(populations: dict[str, tuple[int, int, int]], available: int) -> tuple[dict[str, int], int]:
    """Rows to take from each stratum (eligible, max_units, total_units) and the units that this reserves.

    Every stratum gets a row; then the one with the least sampled part gets the next, at the price of its dearest row, until
    it is exhausted or its price doesn't fit, from when on it gets none. If everything fits, everything is taken.
    """
    least = sum(m for _, m, _ in populations.values())
    if least > available:
        raise ValueError(f"the budget can't cover one speech in each of {len(populations)} country months: conservative minimum {least} units, {available} there")
    if (whole := sum(t for _, _, t in populations.values())) <= available:
        return {k: n for k, (n, _, _) in populations.items()}, whole
    taken, reserved = dict.fromkeys(populations, 1), least
    queue = [(1 / n, k) for k, (n, _, _) in populations.items() if n > 1]
    heapq.heapify(queue)
    while queue:
        _, k = heapq.heappop(queue)
        n, price, _ = populations[k]
        if reserved + price <= available:
            taken[k] += 1
            reserved += price
            if taken[k] < n:
                heapq.heappush(queue, (taken[k] / n, k))
    return taken, reserved


def budget_plan(rows: DataFrame, budget: float, price: float) -> DataFrame:
    """The strata with selected, inclusion_probability and weight. Only the strata (countries times months) reach the driver."""
    found = strata(rows).collect()
    taken, _ = allocate({r.stratum: (r.eligible, r.max_units, r.total_units) for r in found}, affordable_units(budget, price))
    data = [(r.stratum, r.eligible, r.max_units, r.total_units, taken[r.stratum], taken[r.stratum] / r.eligible) for r in sorted(found)]
    plan = rows.sparkSession.createDataFrame(data, "stratum string, eligible long, max_units long, total_units long, selected long, inclusion_probability double")
    return plan.withColumn("weight", 1 / F.col("inclusion_probability"))


def stratified_sample(rows: DataFrame, plan: DataFrame, seed: int = SEED, min_words: int = 40) -> DataFrame:
    """The rows of each stratum with the lowest seeded hashes, as many as the plan's `selected`, with sampling_weight.

    plan has a row per stratum and is broadcast (countries times months). No stratum is sorted in one task: the prefix of its
    hash order is found by a histogram.
    """
    kept = rows.where((F.col("words") >= min_words) & F.col("day").isNotNull()).withColumn("stratum", stratum(F.col("country"), F.col("day")))
    placed = kept.join(F.broadcast(plan.select("stratum", F.col("selected").cast("double").alias("_n"), F.col("weight").alias("sampling_weight"))), "stratum")
    key = priority(F.lit(seed), F.col("stratum"), F.col("speech_id"))
    placed = placed.withColumns({"_key": key, "_unit": F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))})
    return hash_prefix(placed, ["stratum"], "_unit", F.lit(1), "_n", "_key").drop("_key", "_unit", "_n")


def review_sample(rows: DataFrame, country: str, count: int, seed: int = SEED) -> DataFrame:
    """`count` rows of a country: count // years of every year, the rest over all years, by lowest hash.

    rows: country, day, speech_id. The ranks are of a constant bound, so that each task keeps its best `count` rows only.
    """
    if count < 1:
        raise ValueError("the sample must have a row")
    own = rows.where((F.col("country") == country) & F.col("day").isNotNull()).withColumns({"year": F.year("day"), "rank_key": priority(F.lit(seed), F.col("speech_id"))})
    yearly = Window.partitionBy("year").orderBy("rank_key", "speech_id")
    top = own.withColumn("_place", F.row_number().over(yearly)).where(F.col("_place") <= count)
    years = own.agg(F.count_distinct("year").alias("_years"))
    quota = F.floor(F.lit(count) / F.greatest(F.col("_years"), F.lit(1)))
    marked = top.join(F.broadcast(years)).withColumn("_first", F.col("_place") <= quota)
    picked = marked.where("_first").withColumn("_group", F.lit(0))
    rest = marked.where("NOT _first").orderBy("rank_key", "speech_id").limit(count).withColumn("_group", F.lit(1))
    ranked = picked.unionByName(rest).orderBy("_group", F.when(F.col("_group") == 0, F.col("year")), "rank_key", "speech_id")
    return ranked.limit(count).drop("_place", "_years", "_first", "_group")


def trial_selection(rows: DataFrame, count: int, country: str | None = None) -> DataFrame:
    """`count` short recent speeches of different texts by lowest hash. rows: country, day, speech_id, words, digest."""
    kept = rows.where(F.col("words").between(40, 100) & (F.col("day") >= "2023-01-01"))
    if country:
        kept = kept.where(F.col("country") == country)
    key = priority(F.lit(2026), F.col("country"), F.date_format("day", "yyyy-MM-dd"), F.col("speech_id"))
    own = kept.withColumn("rank_key", key)
    # of equal texts only the one of least rank can be chosen
    least = own.groupBy("digest").agg(F.min(F.struct("rank_key", "country", "day", "speech_id", "words")).alias("s"))
    return least.select("s.*").orderBy("rank_key").limit(count)


def control_candidates(rows: DataFrame, seed: int = SEED, years: tuple[int, int] = (2018, 2021), min_words: int = 40) -> DataFrame:
    """The first row by hash of every speaker in every bucket (country, year, party, length). A missing speaker is its own."""
    kept = rows.where(F.year("day").between(*years) & (F.col("words") >= min_words) & (F.col("country") != "") & (F.col("speech_id") != ""))
    made = kept.select(
        "country", F.year("day").alias("year"), F.coalesce(F.nullif("party", F.lit("")), F.lit(schema.UNKNOWN)).alias("party"), length_band(F.col("words")).alias("band"),
        F.coalesce(known_id(F.col("speaker_id")), "speech_id").alias("speaker"), priority(F.lit(seed), F.col("speech_id")).alias("rank_key"), "speech_id", "day",
    )
    bucket = ["country", "year", "party", "band"]
    return made.groupBy(*bucket, "speaker").agg(F.min(F.struct("rank_key", "speech_id", "day")).alias("s")).select(*bucket, "speaker", "s.*")


def draw_controls(candidates: pd.DataFrame, size: int, per_speaker: int, seed: int) -> list[int]:
    """Positions of the drawn candidates of one country.

    The years take turns; within a year the buckets do, in a seeded order, each giving its next row whose speaker isn't full.
    Years get equal quotas first; what some can't fill is given to the others after.
    """
    lanes: dict[int, list[list[int]]] = {}
    for (year, party, band), part in candidates.groupby(["year", "party", "band"], sort=True):
        key = (candidates["country"].iat[0], int(year), party, band)
        order = hashlib.sha256(f"{seed}|{key}".encode()).hexdigest()
        lanes.setdefault(int(year), []).append([order, part.sort_values("rank_key").index.tolist()[::-1]])
    for found in lanes.values():
        found.sort(key=lambda x: x[0])
    years, speaker = sorted(lanes), candidates["speaker"]
    turn, used, drawn = dict.fromkeys(years, 0), {}, {y: [] for y in years}

    def draw(year: int) -> bool:
        found = lanes[year]
        for step in range(len(found)):
            at = (turn[year] + step) % len(found)
            waiting = found[at][1]
            while waiting:
                k = waiting.pop()
                if used.get(speaker[k], 0) < per_speaker:
                    used[speaker[k]] = used.get(speaker[k], 0) + 1
                    drawn[year].append(k)
                    turn[year] = (at + 1) % len(found)
                    return True
        return False

    quota = {y: size // len(years) + (i < size % len(years)) for i, y in enumerate(years)}
    live = True
    while live:
        live = any([draw(y) for y in years if len(drawn[y]) < quota[y]])
    live = True
    while live and sum(map(len, drawn.values())) < size:
        live = False
        for y in years:
            if sum(map(len, drawn.values())) < size:
                live |= draw(y)
    return [k for y in years for k in drawn[y]]


def historical_controls(rows: DataFrame, size: int, seed: int = SEED, per_speaker: int = 2, years: tuple[int, int] = (2018, 2021), min_words: int = 40) -> DataFrame:
    """`size` early speeches of each country, balanced over years, parties and lengths: country, year, party, band, speaker, speech_id, day.

    The draw is sequential within a country. It needs no more of a bucket than the `size` first candidates times the rows that
    per_speaker may skip; each speaker is in a bucket once, so the first size + candidates-of-full-speakers suffice: the
    candidates are cut to the `size * 2` first of each bucket before they meet in one task per country.
    """
    if size < 1 or per_speaker < 1 or years[0] > years[1] or min_words < 0:
        raise ValueError("size, cap, years or least words are out of range")
    bucket = Window.partitionBy("country", "year", "party", "band").orderBy("rank_key")
    most = 2 * size
    few = control_candidates(rows, seed, years, min_words).withColumn("_place", F.row_number().over(bucket)).where(F.col("_place") <= most).drop("_place")

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        return part.loc[draw_controls(part, size, per_speaker, seed)].drop(columns="rank_key")

    return few.groupBy("country").applyInPandas(draw, few.drop("rank_key").schema)



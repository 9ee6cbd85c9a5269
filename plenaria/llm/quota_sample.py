"""Problem 7: a sample whose shares by cell follow given targets, and a report of the targets that can't be met.

Only counts of the cross-classified cells go to the driver; their number is bounded by the cells that the targets define,
whatever the rows. A minimum-cost flow turns them into integer quotas: supply enters the targets in steps (minimum rows,
whole share, rounding unit, refill) and leaves through the cells' availability. What a target asks beyond its cells leaves
through its slack arc: with all cells to itself that's its shortfall, beside the other targets what it must do without. The rows of each quota are the first ones in a seeded hash order, drawn without
sorting a cell.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.countries import country_name
from plenaria.functions.deliveries import first_delivery
from plenaria.functions.ranks import hash_prefix, unit_hash
from plenaria.functions.text import any_date, word_count
from plenaria.llm.flow import Network
from plenaria.runtime import cut, table

MIN_WORDS = 40
SHARE_OF_ROWS = Decimal("0.1")
SEED = "plenaria-quota-1"
REPORT = "target_id int, asked bigint, available bigint, quota bigint, shortfall bigint, contested bigint"


def period_group(date: Column) -> Column:
    return F.when(F.year(date) <= 2021, "control").when(F.year(date) == 2022, "transition").when(F.year(date) >= 2023, "post")


def eligible(speeches: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct speech_ids whose first delivery has a date and at least min_words counted words: speech_id, country, period_group, words.

    Dates in other notations count; null, empty and impossible ones don't. The words are counted before the shuffle, which
    moves no text.
    """
    columns = {"country": country_name(F.col("country")), "date": any_date(F.col("date")), "words": word_count(F.col("speech_text"))}
    first = first_delivery(speeches, columns)
    kept = first.where(F.col("date").isNotNull() & (F.col("words") >= min_words))
    return kept.select("speech_id", "country", period_group(F.col("date")).alias("period_group"), "words")


def _target_rows(targets: DataFrame) -> list:
    rows = sorted(targets.select("target_id", "country", "period_group", "min_words", "max_words", F.col("target_share").cast("string").alias("share"), "min_rows").collect(), key=lambda r: r.target_id)
    return [r for r in rows if r.target_id is not None]


def _fits(r) -> Column:
    test = F.lit(True)
    if r.country is not None:
        test &= F.col("country") == r.country
    if r.period_group is not None:
        test &= F.col("period_group") == r.period_group
    if r.min_words is not None:
        test &= F.col("words") >= r.min_words
    if r.max_words is not None:
        test &= F.col("words") <= r.max_words
    return F.coalesce(test, F.lit(False))


def celled(rows: DataFrame, targets: list) -> DataFrame:
    """rows with `cell`: the sorted ids of the targets that a row falls into, as a string ('' for none)."""
    inside = [F.when(_fits(r), F.lit(str(r.target_id))) for r in targets]
    return rows.withColumn("cell", F.concat_ws(",", *inside) if inside else F.lit(""))


def quotas(counts: dict[str, int], targets: list, eligible_rows: int) -> tuple[list[tuple], dict[str, int]]:
    """The report rows and the quota of each cell ('' is the rest that no target asks for and gets none)."""
    size = int(eligible_rows * SHARE_OF_ROWS)
    asks = {}
    for r in targets:
        share = Decimal(r.share or 0) * size
        asks[r.target_id] = (max(int(share.to_integral_value(ROUND_CEILING)), r.min_rows or 0), share)

    def network(arcs, own: bool = False) -> tuple[Network, dict, dict]:
        """Targets and cells; own: every target has all rows of its cells to itself."""
        net, into, through = Network(), {}, {}
        for r in targets:
            into[r.target_id] = [net.arc("source", r.target_id, capacity, cost) for capacity, cost in arcs(r)]
            for cell, n in counts.items():
                if str(r.target_id) in cell.split(","):
                    net.arc(r.target_id, ("cell", r.target_id, cell) if own else ("cell", cell), n)
                    if own:
                        net.arc(("cell", r.target_id, cell), "sink", n)
        for cell, n in counts.items():
            through[cell] = net.arc(("cell", cell), "sink", n)
        return net, into, through

    def slack(own: bool) -> dict[int, int]:
        """What of each target's rows leaves through its slack arc, which is dearer than any cell."""
        net, _, _ = network(lambda r: [(asks[r.target_id][0], 0)], own)
        arcs = {r.target_id: net.arc(r.target_id, "sink", asks[r.target_id][0], 1000) for r in targets}
        net.send("source", "sink", sum(a for a, _ in asks.values()))
        return {t: net.flow(k) for t, k in arcs.items()}

    short, beside = slack(True), slack(False)

    # the sample itself: minimum rows first, then whole shares, then rounding units by their remainder, then a refill
    def steps(r):
        share, least = asks[r.target_id][1], r.min_rows or 0
        whole = max(0, int(share) - least)
        unit = int(int(share) + 1 > least)
        # a refill in steps of a tenth of the share each, ever dearer, so that all targets that can give take alike
        refill = [(int(share) // 10 + 1, 2000 + k) for k in range(50)]
        return [(least, 0), (whole, 1), (unit, 1002 - int((share - int(share)) * 1000)), *refill, (sum(counts.values()), 3000)]

    net, into, through = network(steps)
    net.send("source", "sink", size)
    available = {r.target_id: sum(n for cell, n in counts.items() if str(r.target_id) in cell.split(",")) for r in targets}
    report = [(t, asks[t][0], available[t], sum(map(net.flow, into[t])), short[t], beside[t]) for t in asks]
    return report, {cell: net.flow(k) for cell, k in through.items() if net.flow(k)}


def plan(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[tuple], dict[str, int], list]:
    """Eligible rows with their cell, the report and the cells' quotas. The driver gets one count per cell only."""
    target_rows = _target_rows(targets)
    cells = celled(rows, target_rows)
    counts = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    report, quota = quotas({c: n for c, n in counts.items() if c}, target_rows, sum(counts.values()))
    return cells, report, quota, target_rows


def quota_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: target_id, asked, available, quota (rows that the sample takes), shortfall (asked and not there),
    contested (asked and not there if all targets are to have what they ask, each row once).

    A null bound, country or period is open. Rows in no target count for the sample's size only. Without rows or without
    targets every figure is 0 but what the minimum rows ask, or the report is empty.
    """
    return rows.sparkSession.createDataFrame(plan(rows, targets)[1], REPORT)


def quota_sample(rows: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """The sampled rows with their cell: as many of each cell as its quota, the first ones by seeded hash of speech_id."""
    cells, _, quota, _ = plan(cut(rows), targets)
    budgets = rows.sparkSession.createDataFrame([(c, float(n)) for c, n in quota.items()], "cell string, _quota double")
    drawn = cells.join(F.broadcast(budgets), "cell").withColumn("_unit", unit_hash(seed, F.col("speech_id")))
    return hash_prefix(drawn, ["cell"], "_unit", F.lit(1), "_quota", "speech_id").drop("_unit", "_quota")


def p7_found(spark, sf_dir):
    report = quota_report(eligible(table(spark, sf_dir, "speeches")), table(spark, sf_dir, "sample_targets"))
    return report.where("shortfall > 0").select("target_id")


def p7_targets(spark, sf_dir):
    """What each target asks, finds and lacks."""
    return p7_report(spark, sf_dir).select("target_id", "asked", "available", "shortfall")


def p7_report(spark, sf_dir):
    return quota_report(eligible(table(spark, sf_dir, "speeches")), table(spark, sf_dir, "sample_targets"))


def p7_sample(spark, sf_dir):
    return quota_sample(eligible(table(spark, sf_dir, "speeches")), table(spark, sf_dir, "sample_targets")).select("speech_id", "country", "period_group", "words")


_ELIGIBLE = r"""
  first AS (SELECT speech_id, min({'at': coalesce(delivered_at, TIMESTAMP '9999-12-31'), 'country': country, 'date': date, 'text': speech_text}) AS f
            FROM speeches WHERE speech_id IS NOT NULL GROUP BY speech_id),
  dated AS (SELECT f.country AS country, len(regexp_extract_all(f.text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')) AS words,
              coalesce(CASE WHEN regexp_matches(f.date, '^\d{4}-\d{2}-\d{2}') THEN try_cast(substr(f.date, 1, 10) AS DATE) END,
                       try_strptime(f.date, '%Y/%m/%d')::DATE,
                       CASE WHEN regexp_matches(f.date, '^\d{8}$') THEN try_strptime(f.date, '%Y%m%d')::DATE END,
                       try_strptime(replace(replace(f.date, '.', '/'), '-', '/'), '%d/%m/%Y')::DATE) AS day FROM first),
  eligible AS (SELECT country, words, CASE WHEN year(day) <= 2021 THEN 'control' WHEN year(day) = 2022 THEN 'transition' ELSE 'post' END AS grp
               FROM dated WHERE day IS NOT NULL AND words >= 40),
  size AS (SELECT count(*) // 10 AS n FROM eligible),
  asked AS (SELECT t.*, greatest(CAST(ceil(CAST(target_share AS DECIMAL(18,6)) * n) AS BIGINT), min_rows) AS ask FROM sample_targets t, size),
  report AS (SELECT a.target_id, a.ask, count(e.grp) AS available
             FROM asked a LEFT JOIN eligible e ON e.country = a.country AND e.grp = a.period_group
              AND e.words >= coalesce(a.min_words, 0) AND e.words <= coalesce(a.max_words, 1000000000) GROUP BY ALL)
"""
SQL = {
    "p7_found": f"WITH {_ELIGIBLE} SELECT target_id FROM report WHERE available < ask",
    "p7_targets": f"WITH {_ELIGIBLE} SELECT target_id, CAST(ask AS BIGINT) AS asked, available, CAST(greatest(ask - available, 0) AS BIGINT) AS shortfall FROM report",
}

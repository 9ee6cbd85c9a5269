"""The whole study: check a corpus, cost it, maybe sample it, score it, and write tables, figures and reports.

The corpus is read once into a compact scored table in the shared folder; sizes, periods, sensitivity and breakdowns all read that.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.countries import COUNTRIES
from plenaria.functions.text import iso_date
from plenaria.operators import aggregate, corpus, cost, quality, sampling, scoring
from plenaria.plans import outputs
from plenaria.runtime import cut
from plenaria.sources import files

REPORTS = {True: "dry_run_report.md", False: "results_report.md"}


class Refused(ValueError):
    """A guard stopped the run before anything was written or paid."""


def finite(name: str, value: float | None, least: float = 0.0, above: bool = False) -> None:
    if value is not None and (not math.isfinite(value) or value < least or above and value <= least):
        raise Refused(f"{name} must be finite and {'positive' if above else 'not negative'}")


def read_corpus(spark: SparkSession, path: str | None, dry_run: bool) -> DataFrame:
    """The speeches of a path, or the invented corpus if a dry run names none. A named path that isn't there is an error."""
    if path is None:
        if not dry_run:
            raise Refused("a paid run needs a corpus")
        return files.mock_corpus(spark)
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else files.with_defaults(files.read_jsonl(spark, path))


def checked(records: DataFrame) -> dict:
    """The audit of the records; defects stop the run, with ten of them in the message."""
    report = quality.audit(records).first().asDict()
    if not report["valid"]:
        found = quality.defects(records).orderBy("speech_id", "defect").limit(10).collect()
        raise Refused("corpus failed QA: " + "; ".join(f"{r.speech_id}: {r.defect}" for r in found) + f" ({report['duplicate_speech_id_count']} duplicate ids)")
    return report


def paid_guard(rows: DataFrame, gaps: dict[str, list | None]) -> None:
    state = quality.readiness(quality.missing_coverage(rows), gaps)
    if not state["ready"]:
        raise Refused("the corpus isn't complete: " + "; ".join(state["blockers"][:10]))


def run_study(
    spark: SparkSession, results: str, corpus_path: str | None = None, dry_run: bool = True, price: float = 0.5, responses: DataFrame | None = None, max_cost: float | None = None,
    sample_budget: float | None = None, seed: int = 2026, gaps: dict[str, list | None] | None = None, control_records: DataFrame | None = None, confirmed: bool = False,
) -> dict:
    """Run it all; returns the summary that is also written. responses: speech_id, ai, mixed; a dry run pretends them."""
    target = Path(results)
    if (target / "reports" / REPORTS[not dry_run]).exists():
        raise Refused(f"{target} has {'paid' if dry_run else 'mock'} outputs; use another directory")
    finite("price", price)
    finite("max_cost", max_cost)
    finite("sample_budget", sample_budget, above=True)
    if sample_budget is not None and max_cost is not None and sample_budget > max_cost:
        raise Refused("the sample budget exceeds the cap")
    if not dry_run and (responses is None or not confirmed):
        raise Refused("a paid run needs responses and a confirmation")
    records = read_corpus(spark, corpus_path, dry_run)
    report = checked(records)
    needed = ["speech_id", "country", iso_date(F.col("date")).alias("day"), F.col("word_count").alias("words"), "party", "legislative_term", "speaker_id", "speaker_role", "speaker_name"]
    rows = cut(records.select(*needed))
    if not dry_run:
        paid_guard(rows, gaps or {})
    spent = 0.0
    if control_records is not None:
        spent = _total(cost.estimate_cost(control_records.select("country", F.col("word_count").alias("words")), price))
    plan = None
    if sample_budget is not None:
        if spent > sample_budget:
            raise Refused("the controls alone exceed the sample budget")
        source = quality.fingerprint(records)
        plan = sampling.budget_plan(rows, sample_budget - spent, price)
        plan_rows = outputs.small_rows(plan, ["stratum"])
        _same_plan(target / "reports" / "sampling_plan.json", {"source": source, "seed": seed, "budget": sample_budget, "price": price, "strata": plan_rows})
        rows = cut(sampling.stratified_sample(rows, plan, seed))
        if quality.fingerprint(read_corpus(spark, corpus_path, dry_run)) != source:
            raise Refused("the corpus changed while it was sampled")
    eligible = rows.where("words >= 40")
    estimate = cost.estimate_cost(eligible, price)
    total = _total(estimate)
    for name, cap in (("the sample budget", sample_budget), ("the cap", max_cost)):
        if cap is not None and not cost.within_cap(total, spent, cap):
            raise PermissionError(f"{total + spent:.4f} exceeds {name} of {cap:.4f}; nothing was sent")
    scored = cut(scoring.score(eligible.where("day IS NOT NULL"), scoring.mock_shares(F.col("speech_id")) if dry_run else responses, must_match=not dry_run))
    summary = {"records": report["records"], "words": report["words"], "estimated_cost": total, "controls_cost": spent, "mocked": dry_run, "sampled": plan is not None}
    _write(spark, target, rows, scored, estimate, summary, dry_run)
    outputs.put_json(target / "reports" / "qa.json", report)
    if plan is not None:
        outputs.put_json(target / "reports" / "sampling_plan.json", {"source": source, "seed": seed, "budget": sample_budget, "price": price, "strata": plan_rows})
    return summary


def _same_plan(path: Path, plan: dict) -> None:
    """A plan that is there already must be the same."""
    import json

    if path.exists() and json.loads(path.read_text(encoding="utf-8")) != json.loads(json.dumps(plan)):
        raise Refused("the sampling plan there differs; use another directory")


def _total(estimate: DataFrame) -> float:
    return estimate.where(F.col("country") == cost.TOTAL).first().estimated_cost


def _write(spark, target: Path, rows: DataFrame, scored: DataFrame, estimate: DataFrame, summary: dict, dry_run: bool) -> None:
    tables = target / "tables"
    place = F.when(F.col("country") == cost.TOTAL, 1).otherwise(0)
    sizes = aggregate.country_sizes(rows, corpus.dimension(spark)).join(corpus.dimension(spark), "country")
    outputs.put_csv(tables / "corpus_size.csv", [{k: v for k, v in r.items() if k != "place"} for r in outputs.small_rows(sizes, ["place"])])
    outputs.put_csv(tables / "cost_estimate.csv", [{k: v for k, v in r.items() if k != "_p"} for r in outputs.small_rows(estimate.withColumn("_p", place), ["_p", "country"])])
    found = outputs.small_rows(aggregate.by_periods(scored), ["granularity", "country", "period"])
    by = {k: [{c: v for c, v in r.items() if c != "granularity"} for r in found if r["granularity"] == k] for k in aggregate.KINDS}
    for kind, name in zip(aggregate.KINDS, ("monthly", "quarterly", "annual"), strict=True):
        outputs.put_csv(tables / f"{name}_results.csv", _ordered(by[kind]))
    annual = cut(aggregate.by_period(scored, "year"))
    outputs.put_csv(tables / "historical_baseline.csv", _ordered(outputs.small_rows(aggregate.baseline(annual), ["country", "period"])))
    outputs.put_csv(tables / "pre_post_comparison.csv", outputs.small_rows(aggregate.pre_post(annual), ["country", "period_group"]))
    outputs.put_csv(tables / "sensitivity.csv", outputs.small_rows(aggregate.sensitivity(scored), ["min_words", "excluded_role", "country", "period"]))
    split = outputs.small_rows(aggregate.breakdowns(scored), ["dimension", "country", "period", "group"])
    for name in ("party", "legislative_term", "length_band", "speaker"):
        outputs.put_csv(tables / f"{name}_breakdown.csv", [{k: v for k, v in r.items() if k != "dimension"} for r in split if r["dimension"] == name])
    for share, label in (("ai_word_share", "AI"), ("mixed_word_share", "mixed"), ("ai_plus_mixed_word_share", "AI and mixed")):
        for country in (None, *COUNTRIES):
            shown = [r for r in by["month"] if country in (None, r["country"])]
            outputs.put(target / "figures" / f"{share}_{(country or 'all').lower()}.svg", outputs.line_chart(shown, f"{label} word share, {country or 'all countries'}", share))
    outputs.write_jsonl(scored.select("speech_id", F.struct("ai", "mixed").alias("response")), str(target / "processed" / "responses.jsonl"))
    lines = [f"# {'Dry run on invented scores' if dry_run else 'Results'}", "", f"{summary['records']:,} speeches, {summary['words']:,} words; estimated cost ${summary['estimated_cost']:,.2f}.", ""]
    lines += [f"* {r['country']} {r['period']}: {r['ai_plus_mixed_word_share']:.2%} of {r['words']:,.0f} words" for r in _ordered(by["year"])]
    outputs.put(target / "reports" / REPORTS[dry_run], "\n".join(lines) + "\n")
    outputs.put_json(target / "reports" / "summary.json", summary)


def _ordered(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (r["country"], r["period"]))


def run_trial(spark: SparkSession, results: str, corpus_path: str, count: int, price: float, configuration: dict, send, country: str | None = None, max_cost: float = 0.05, confirmed: bool = False, gaps: dict | None = None) -> dict:
    """Score one to three real short speeches with all the guards of a paid run. send(text) returns a response."""
    if not confirmed:
        raise PermissionError("a paid trial needs a confirmation")
    if not 1 <= count <= 3:
        raise Refused("a trial has one to three speeches")
    if country is not None and country not in COUNTRIES:
        raise Refused(f"unknown country {country}")
    finite("price", price)
    finite("max_cost", max_cost)
    records = read_corpus(spark, corpus_path, dry_run=False)
    checked(records)
    rows = records.select("speech_id", "country", iso_date(F.col("date")).alias("day"), F.col("word_count").alias("words"), F.sha2("speech_text", 256).alias("digest"))
    paid_guard(rows, gaps or {})
    chosen = sampling.trial_selection(rows, count, country)
    texts = {r.speech_id: r.speech_text for r in records.join(chosen.select("speech_id"), "speech_id", "left_semi").select("speech_id", "speech_text").collect()}
    picked = chosen.collect()
    if len(picked) < count:
        raise Refused(f"only {len(picked)} different short speeches since 2023; {count} asked")
    total = sum(math.ceil(r.words / 100) for r in picked) * price / 10
    if not cost.within_cap(total, 0.0, max_cost):
        raise PermissionError(f"{total:.4f} exceeds the cap of {max_cost:.4f}")
    selection = [{"speech_id": r.speech_id, "country": r.country, "date": str(r.day), "word_count": r.words, "cache_fingerprint": files.request_fingerprint(configuration, texts[r.speech_id])} for r in picked]
    path = Path(results) / "api_test" / "selection.json"
    _same_plan(path, {"configuration": configuration, "speeches": selection})
    outputs.put_json(path, {"configuration": configuration, "speeches": selection})
    done = [s | {"response": send(texts[s["speech_id"]])} for s in selection]
    outputs.put_json(path.with_name("test_result.json"), {"completed_speeches": done, "note": "A score of a short speech proves nothing about its author."})
    return {"speeches": done, "estimated_cost": total}

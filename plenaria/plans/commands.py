"""The commands: python -m plenaria.plans.commands COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.countries import COUNTRIES
from plenaria.functions.text import iso_date
from plenaria.operators import controls, corpus, cost, provenance, quality, review, sampling
from plenaria.plans import outputs, study
from plenaria.sources import builders, files

#: What a command may not be given together, by command: (options of one kind, options of the other).
EXCLUSIVE = {
    "run": [(("dry_run",), ("responses", "confirm")), (("trial",), ("dry_run", "sample_budget", "responses"))],
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plenaria", description="Build, check, cost, sample and measure a corpus of speeches.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, corpus_needed: bool = True, **numbers: int) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("--corpus", required=corpus_needed)
        for option, value in numbers.items():
            p.add_argument(f"--{option.replace('_', '-')}", type=int, default=value)
        return p

    for name in ("run", "dry-run"):
        p = command(name, "the whole study", corpus_needed=False, seed=2026)
        p.add_argument("--results", default="results")
        p.add_argument("--price", type=float, default=0.5)
        p.add_argument("--max-cost", type=float)
        p.add_argument("--sample-budget", type=float)
        p.add_argument("--controls", help="records of controls, whose cost comes first")
        if name == "run":
            p.add_argument("--dry-run", action="store_true", help="invented scores, no cost")
            p.add_argument("--responses", help="Parquet of speech_id, ai, mixed: what the paid service gave")
            p.add_argument("--confirm", action="store_true", help="needed for anything that is paid")
            p.add_argument("--trial", type=int, help="only one to three short speeches, by the service behind `send`")
            p.add_argument("--country", choices=COUNTRIES, help="of a trial")
            p.add_argument("--gaps", action="append", default=[], metavar="COUNTRY=FILE", help="JSON list of open gaps")
    p = command("estimate", "what scoring costs")
    p.add_argument("--price", type=float, default=0.5)
    p.add_argument("--country", choices=COUNTRIES)
    p.add_argument("--year", type=int, action="append")
    p.add_argument("--period", choices=("historical", "post"))
    command("qa", "integrity of a corpus", start_year=2018, end_year=2026)
    p = command("sample", "early speeches balanced over years, parties and lengths", size=1000, seed=2026, max_per_speaker=2, min_words=40, start_year=2018, end_year=2021)
    p.add_argument("--output", required=True)
    p = command("review", "records to hold against their sources", count=10, seed=2026)
    p.add_argument("--country", choices=COUNTRIES, required=True)
    p.add_argument("--packet")
    p.add_argument("--report")
    p.add_argument("--output")
    p = command("build", "a corpus from raw files", corpus_needed=False, start_year=2018, end_year=2026)
    p.add_argument("--country", choices=COUNTRIES, help="all six without")
    p.add_argument("--raw", required=True, help="folder of raw files by country")
    p.add_argument("--output", required=True)
    p.add_argument("--resume-partial", action="store_true", help="finish a broken-off output of a country")
    p = command("controls", "synthetic passages", corpus_needed=False)
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--brief", choices=COUNTRIES)
    one.add_argument("--import-from")
    one.add_argument("--validate")
    p.add_argument("--output")
    p = command("provenance", "files held against their manifest", corpus_needed=False)
    p.add_argument("--raw", required=True)
    p.add_argument("--manifest", required=True)
    p.add_argument("--output", required=True)
    p = commands.add_parser("brief", help="what a passage for a country must be like")
    p.add_argument("--country", choices=COUNTRIES, default=COUNTRIES[0])
    return out


def checked(p: argparse.ArgumentParser, args: argparse.Namespace) -> argparse.Namespace:
    """Refuse options that exclude each other or miss the one they belong to."""
    given = lambda name: getattr(args, name, None) not in (None, False, [])
    shown = lambda name: "--" + name.replace("_", "-")
    for one, other in EXCLUSIVE.get(args.command, []):
        for a in one:
            for b in other:
                if given(a) and given(b):
                    p.error(f"{shown(a)} can't be combined with {shown(b)}")
    if args.command == "run":
        if not args.dry_run and not args.confirm:
            p.error("a paid run needs --confirm")
        if args.country and not args.trial:
            p.error("--country belongs to --trial")
        if not args.dry_run and not args.trial and not args.responses:
            p.error("a paid run needs --responses")
    if args.command == "review" and not (args.packet or args.report or args.output):
        p.error("choose --packet, --report or --output")
    if args.command == "build" and args.resume_partial and not args.country:
        p.error("--resume-partial is for one country")
    return args


def show(value: object) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def gap_lists(given: list[str]) -> dict[str, list | None]:
    """The gap lists by country; a file that isn't there is None."""
    out: dict[str, list | None] = {}
    for x in given:
        country, _, path = x.partition("=")
        out[country] = json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else None
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    return study.read_corpus(spark, path, dry_run=False)


def sized(rows: DataFrame) -> DataFrame:
    return rows.select("speech_id", "country", iso_date(F.col("date")).alias("day"), F.col("word_count").alias("words"), F.col("party"), F.col("speaker_id"))


def run(spark, args, send: Callable[[str], dict] | None) -> int:
    dry = args.command == "dry-run" or args.dry_run
    gaps = gap_lists(getattr(args, "gaps", []))
    if not dry and args.trial:
        if send is None:
            raise study.Refused("a trial needs a service")
        show(study.run_trial(spark, args.results, args.corpus, args.trial, args.price, {}, send, args.country, 0.05 if args.max_cost is None else args.max_cost, args.confirm, gaps))
        return 0
    responses = None if dry else spark.read.parquet(args.responses)
    passages = records(spark, args.controls) if args.controls else None
    show(study.run_study(spark, args.results, args.corpus, dry, args.price, responses, args.max_cost, args.sample_budget, args.seed, gaps, passages, not dry and args.confirm))
    return 0


def estimate(spark, args, _) -> int:
    found = cost.estimate_cost(corpus.filtered(sized(records(spark, args.corpus)), args.country, args.year, args.period), args.price)
    show(outputs.small_rows(found.withColumn("_last", F.col("country") == cost.TOTAL), ["_last", "country"]))
    return 0


def qa(spark, args, _) -> int:
    rows, years = records(spark, args.corpus), (args.start_year, args.end_year)
    report = quality.audit(rows, years).first().asDict()
    report["errors"] = quality.first_errors(rows)
    report["warnings"] = [f"record {r.speech_id}: {r.warning}" for r in quality.warnings(rows, years, 1000).collect()]
    report["duplicate_speech_ids"] = [r.speech_id for r in quality.duplicate_ids(rows, "speech_id").collect()]
    show(report)
    return int(not report["valid"])


def sample(spark, args, _) -> int:
    rows = records(spark, args.corpus)
    drawn = sampling.historical_controls(sized(rows), args.size, args.seed, args.max_per_speaker, (args.start_year, args.end_year), args.min_words)
    found = rows.join(drawn.select("speech_id"), "speech_id", "left_semi").orderBy("country", "date", "speech_id")
    outputs.write_jsonl(found, args.output)
    show({"output": args.output, "seed": args.seed} | found.agg(F.count(F.lit(1)).alias("records"), F.sum("word_count").alias("words")).first().asDict())
    return 0


def review_records(spark, args, _) -> int:
    rows = records(spark, args.corpus)
    ids = sampling.review_sample(sized(rows), args.country, args.count, args.seed).select("speech_id")
    picked = rows.join(F.broadcast(ids), "speech_id").withColumn("status", review.containment(F.col("speech_text"), F.col("raw_text")))
    if args.output:
        outputs.write_jsonl(picked.drop("status"), args.output)
    shown = outputs.small_rows(picked.withColumn("text", F.col("speech_text")), ["date", "speech_id"])
    if args.packet:
        outputs.put(args.packet, outputs.review_packet(shown))
    counts = quality.status_counts(picked, ["country"], "status", ("verified", "normalized", "partial", "mismatch")).collect()
    summary = {"country": args.country, "sampled": len(shown), "seed": args.seed, "status_counts": counts[0].asDict() if counts else {}}
    if args.report:
        outputs.put_json(args.report, summary | {"results": [{k: r[k] for k in ("speech_id", "status")} for r in shown]})
    show(summary)
    return int(not shown or bool(summary["status_counts"].get("mismatch")))


def raw_tables(spark: SparkSession, folder: str, country: str) -> dict[str, DataFrame]:
    """The tables that a country's builder takes, from the folders below: archives, xml, html, lines (with known.json lines of
    path and known), meetings and metadata as JSON lines."""
    place = Path(folder, country.lower())
    known = spark.read.schema("path string, known string").json(str(place / "known.jsonl")) if (place / "known.jsonl").exists() else spark.createDataFrame([], "path string, known string")

    def raw(kind: str) -> DataFrame:
        if not (place / kind).exists():
            return spark.createDataFrame([], "path string, content binary, known string")
        found = files.raw_files(spark, str(place / kind)).select(F.substring_index("path", "/", -1).alias("path"), "content")
        return found.join(known, "path", "left")

    out = {k: raw(k) for k in ("archives", "xml", "html", "lines")}
    if (place / "meetings.jsonl").exists():
        out["meetings"] = spark.read.schema("Id string, Datum string, Verslag array<struct<Id:string,Soort:string,Status:string,GewijzigdOp:string,Verwijderd:boolean>>").json(str(place / "meetings.jsonl"))
    if (place / "statements.jsonl").exists():
        key = "term string, proceeding bigint, date string, num bigint"
        out["metadata"] = spark.read.schema(f"{key}, name string, memberID string, function string, unspoken boolean, source_url string").json(str(place / "statements.jsonl"))
        at = r"term-(\d+)/proceeding-(\d+)/(\d{4}-\d{2}-\d{2})/statement-(\d+)\.html$"
        bodies = files.raw_files(spark, str(place / "bodies"))
        part = lambda k: F.regexp_extract("path", at, k)
        out["bodies"] = bodies.select(part(1).alias("term"), part(2).cast("bigint").alias("proceeding"), part(3).alias("date"), part(4).cast("bigint").alias("num"), "content")
    return out


def build(spark, args, _) -> int:
    years = (args.start_year, args.end_year)
    wanted = [args.country] if args.country else list(COUNTRIES)
    built = {c: builders.BUILDERS[c](raw_tables(spark, args.raw, c), years) for c in wanted}
    if args.country:
        ordered = sampling.positioned(built[args.country].speeches, ["date", "session_id", "speech_id"])
        if args.resume_partial:
            show({"appended": builders.resume(spark, f"{args.output}.tmp", ordered, args.output)})
        else:
            ordered.write.mode("overwrite").parquet(f"{args.output}.tmp")
            builders.promote(spark, f"{args.output}.tmp", args.output)
        show({"country": args.country, "counts": [r.asDict() for r in built[args.country].counts().collect()], "gaps": built[args.country].gaps.count()})
        return 0
    speeches, state = builders.combined(built)
    outputs.write_corpus(speeches.withColumn("day", iso_date(F.col("date"))), args.output)
    show(state)
    return int(not state["ready"])


def passages(spark, args, _) -> int:
    if args.brief:
        show(controls.brief(args.brief))
        return 0
    good, bad = controls.normalize(spark.read.json(args.import_from or args.validate))
    wrong = [r.problem for r in bad.select("problem").limit(10).collect()]
    if wrong:
        raise study.Refused("controls are invalid: " + "; ".join(wrong))
    if args.import_from:
        if not args.output:
            raise study.Refused("--import-from needs --output")
        outputs.write_jsonl(good.orderBy("country", "speech_id"), args.output)
    show({"records": good.count(), "missing": sorted(r.country for r in controls.missing_countries(good).collect())})
    return 0


def manifest(spark, args, _) -> int:
    found = files.file_digests(files.raw_files(spark, args.raw))
    root = Path(args.raw).resolve()
    relative = F.regexp_extract("path", r"(?:^file:)?/*(.*)$", 1)
    short = F.expr(f"substring(`_r`, {len(str(root).lstrip('/')) + 2})")
    current = found.withColumn("_r", relative).select(provenance.source_address(short).alias("source_url"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("retrieved_at_utc"), short.alias("local_path"), "bytes", "sha256", provenance.content_type(short).alias("content_type"))
    existing = provenance.last_entries(files.read_jsonl(spark, args.manifest, "source_url string, retrieved_at_utc string, local_path string, bytes bigint, sha256 string, content_type string, retrieved_at_utc_basis string, provenance_status string"))
    merged = provenance.reconcile(existing, current)
    outputs.write_jsonl(merged.drop("change").orderBy("local_path"), args.output)
    show({r.change: r["count"] for r in merged.groupBy("change").count().collect()})
    return 0


RUN: dict[str, Callable] = {
    "run": run, "dry-run": run, "estimate": estimate, "qa": qa, "sample": sample, "review": review_records, "build": build, "controls": passages, "provenance": manifest,
}


def main(argv: list[str] | None = None, send: Callable[[str], dict] | None = None) -> int:
    p = parser()
    args = checked(p, p.parse_args(argv))
    if args.command == "brief":
        show(controls.brief(args.country))
        return 0
    spark = SparkSession.builder.appName("plenaria").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return RUN[args.command](spark, args, send)


if __name__ == "__main__":
    sys.exit(main())

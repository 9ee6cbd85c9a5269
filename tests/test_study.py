import csv
import json

import pytest

from plenaria.plans import commands, outputs, study
from plenaria.sources import builders, files


def rows(path):
    return list(csv.DictReader(open(path, encoding="utf-8")))


def test_dry_run_on_the_invented_corpus(spark, tmp_path):
    out = tmp_path / "r"
    summary = study.run_study(spark, str(out))
    assert (summary["records"], summary["words"], round(summary["estimated_cost"], 9)) == (36, 2124, 1.8)
    costs = rows(out / "tables" / "cost_estimate.csv")
    assert len(costs) == 7 and costs[-1]["country"] == "TOTAL" and costs[-1]["estimated_api_units"] == "36"
    annual = {(r["country"], r["period"]): r for r in rows(out / "tables" / "annual_results.csv")}
    assert len(annual) == 12
    france = annual["France", "2019"]
    assert round(float(france["ai_word_share"]), 6) == 0.046667 and round(float(france["mixed_word_share"]), 6) == 0.086667
    assert len(list((out / "figures").glob("*.svg"))) == 21 and (out / "reports" / "dry_run_report.md").exists()
    assert [r["country"] for r in rows(out / "tables" / "corpus_size.csv")] == list(files.COUNTRIES)
    with pytest.raises(study.Refused):
        study.run_study(spark, str(out), dry_run=False, responses=spark.range(1), confirmed=True)
    before = (out / "tables" / "annual_results.csv").read_text()
    study.run_study(spark, str(out))
    assert (out / "tables" / "annual_results.csv").read_text() == before


def test_budget_and_guards(spark, tmp_path):
    out = str(tmp_path / "r")
    summary = study.run_study(spark, out, sample_budget=1.8)
    assert summary["sampled"] and summary["estimated_cost"] <= 1.8
    with pytest.raises(study.Refused):
        study.run_study(spark, out, sample_budget=1.9)
    for bad in ({"max_cost": -1.0}, {"sample_budget": 0.0}, {"sample_budget": 3.0, "max_cost": 1.0}, {"price": float("nan")}, {"dry_run": False}):
        with pytest.raises(ValueError):
            study.run_study(spark, str(tmp_path / "x"), **bad)
    with pytest.raises(PermissionError):
        study.run_study(spark, str(tmp_path / "y"), max_cost=0.1)
    with pytest.raises(FileNotFoundError):
        study.run_study(spark, str(tmp_path / "z"), corpus_path=str(tmp_path / "none.jsonl"))
    with pytest.raises(ValueError, match="conservative minimum"):
        study.run_study(spark, str(tmp_path / "w"), sample_budget=0.05)


def corpus_file(spark, path, change=None):
    mock = files.mock_corpus(spark)
    outputs.write_jsonl(change(mock) if change else mock, path)
    return path


def test_defects_stop_a_run(spark, tmp_path):
    good = corpus_file(spark, str(tmp_path / "a.jsonl"))
    assert study.run_study(spark, str(tmp_path / "r"), good)["records"] == 36
    bad = corpus_file(spark, str(tmp_path / "b.jsonl"), lambda d: d.withColumn("word_count", d.word_count + 1))
    with pytest.raises(study.Refused, match="inconsistent word count"):
        study.run_study(spark, str(tmp_path / "s"), bad)


def test_trial(spark, tmp_path):
    from pyspark.sql import functions as F

    years = spark.range(2018, 2026).select(F.col("id").cast("int").alias("y"))

    def change(mock):
        d = mock.where("date LIKE '2024-02%'").join(years)
        key = F.concat("speech_id", F.lit("-"), "y")
        text = F.concat("speech_text", F.lit(" "), F.translate(key, "-", "x"))
        return d.withColumns({"speech_id": key, "source_identifier": key, "date": F.concat("y", F.lit("-02-01")), "speech_text": text, "raw_text": text, "word_count": F.lit(60)}).drop("y")

    path = corpus_file(spark, str(tmp_path / "a.jsonl"), change)
    go = lambda **k: study.run_trial(spark, str(tmp_path / "r"), path, **({"count": 2, "price": 0.5, "configuration": {"model": "m"}, "send": lambda t: {"of": t[:5]}, "confirmed": True, "max_cost": 1.0} | k))
    assert len(go()["speeches"]) == 2 and json.loads((tmp_path / "r" / "api_test" / "test_result.json").read_text())["completed_speeches"]
    for bad in ({"count": 4}, {"country": "Atlantis"}, {"count": 1}):
        with pytest.raises(ValueError):
            go(**bad)
    for bad in ({"confirmed": False}, {"max_cost": 0.01}):
        with pytest.raises(PermissionError):
            go(**bad)


def test_small_outputs(tmp_path):
    outputs.put_csv(tmp_path / "e.csv", [])
    assert (tmp_path / "e.csv").read_text() == "\n"
    chart = outputs.line_chart([{"country": "A", "period": "2020", "s": 0.5}, {"country": "A", "period": "2021", "s": 0.1}], "<t>", "s")
    assert chart.count("<circle") == 2 and "&lt;t&gt;" in chart and outputs.line_chart([], "t", "s").startswith("<svg")
    assert "**partial**" in outputs.review_packet([{"speech_id": "a", "status": "partial", "text": "x" * 5000}])


def test_commands(spark, tmp_path, capsys):
    path = corpus_file(spark, str(tmp_path / "a.jsonl"))
    said = lambda *argv, code=0: (commands.main([str(a) for a in argv]) == code, json.loads(capsys.readouterr().out))
    assert said("brief", "--country", "Spain")[1]["parliament"] == "Congreso de los Diputados"
    ok, report = said("qa", "--corpus", path, "--end-year", 2020)
    assert ok and report["records"] == 36 and len(report["warnings"]) == 18 and report["errors"] == []
    assert said("estimate", "--corpus", path, "--period", "post")[1][-1]["country"] == "TOTAL"
    ok, drawn = said("sample", "--corpus", path, "--size", 1, "--output", tmp_path / "s.jsonl")
    assert ok and drawn["records"] == 6 and [r.country for r in spark.read.json(str(tmp_path / "s.jsonl")).collect()] == sorted(files.COUNTRIES)
    ok, found = said("review", "--corpus", path, "--country", "Italy", "--count", 4, "--packet", tmp_path / "p.md", "--report", tmp_path / "r.json", "--output", tmp_path / "r.jsonl")
    assert ok and found["status_counts"]["verified"] == 4 and (tmp_path / "p.md").read_text().count("**verified**") == 4 and len(json.loads((tmp_path / "r.json").read_text())["results"]) == 4
    assert said("run", "--dry-run", "--results", tmp_path / "x")[1]["mocked"]
    spark.read.json(path).select("speech_id", commands.F.lit(0.1).alias("ai"), commands.F.lit(0.0).alias("mixed")).write.parquet(str(tmp_path / "resp"))
    with pytest.raises(study.Refused, match="complete"):  # the invented corpus hasn't all years
        commands.main(["run", "--confirm", "--corpus", path, "--responses", str(tmp_path / "resp"), "--results", str(tmp_path / "y")])


@pytest.mark.parametrize(
    "argv",
    [
        "qa", "run --corpus x", "run --confirm --corpus x", "run --dry-run --confirm", "run --dry-run --responses x", "run --trial 1 --dry-run", "run --trial 1 --confirm --sample-budget 2", "run --dry-run --country Italy",
        "review --corpus x --country Italy", "controls --brief Italy --validate x", "controls", "build --raw x --output y --resume-partial", "estimate --corpus x --period never", "nothing",
    ],
)
def test_options_that_exclude_each_other(argv, capsys):
    with pytest.raises(SystemExit):
        commands.main(argv.split())
    assert "error" in capsys.readouterr().err


def test_build_and_resume(spark, tmp_path, capsys):
    place = tmp_path / "raw" / "poland"
    day = place / "bodies" / "term-10" / "proceeding-3" / "2024-01-16"
    day.mkdir(parents=True)
    rows = [{"term": "10", "proceeding": 3, "date": "2024-01-16", "num": n, "name": f"Poseł {n}", "memberID": str(n), "function": "", "unspoken": n == 3, "source_url": "u"} for n in (4, 1, 2, 3)]
    (place / "statements.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for n in (1, 2, 3):
        (day / f"statement-{n}.html").write_text(f"<p>Słowo {n}.</p>")
    out = str(tmp_path / "poland.parquet")
    assert commands.main(["build", "--country", "Poland", "--raw", str(tmp_path / "raw"), "--output", out]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["counts"][0]["records"] == 2 and report["gaps"] == 1
    whole = spark.read.parquet(out)
    assert [(r.position, r.speech_text) for r in whole.orderBy("position").collect()] == [(1, "Słowo 1."), (2, "Słowo 2.")]
    whole.where("position = 1").write.parquet(str(tmp_path / "part.tmp"))
    assert builders.resume(spark, str(tmp_path / "part.tmp"), whole, str(tmp_path / "part")) == 1 and spark.read.parquet(str(tmp_path / "part")).count() == 2
    whole.where("position = 1").withColumn("speech_text", commands.F.lit("x")).write.parquet(str(tmp_path / "other.tmp"))
    with pytest.raises(ValueError, match="position 1"):
        builders.resume(spark, str(tmp_path / "other.tmp"), whole, str(tmp_path / "other"))


def test_builders(spark):
    empty = spark.createDataFrame([], "path string, content binary, known string")
    xml = """<vlos xmlns="urn:v"><vergadering objectid="V"><datum>2022-02-01</datum><woordvoerder objectid="w"><spreker><weergavenaam>Jan</weergavenaam></spreker><tekst><alinea><alineaitem>Ja.</alineaitem></alinea></tekst></woordvoerder></vergadering></vlos>"""
    dutch = spark.createDataFrame([(f"a/{n}.xml", xml.encode(), '{"source_url": "u"}') for n in ("R1", "R9")], "path string, content binary, known string")
    reports = [("m1", "2022-02-01", [("R1", "Eindpublicatie", "Gecorrigeerd", "2", False), ("R0", "Eindpublicatie", "Gecorrigeerd", "1", False)]), ("m2", "2022-02-02", [("R2", "Eindpublicatie", "Gecorrigeerd", "2", False)]), ("m3", "2022-02-03", [("R9", "Tussenpublicatie", "x", "2", False)])]
    meetings = spark.createDataFrame(reports, "Id string, Datum string, Verslag array<struct<Id:string,Soort:string,Status:string,GewijzigdOp:string,Verwijderd:boolean>>")
    built = {"Netherlands": builders.netherlands({"meetings": meetings, "xml": dutch})}
    assert [r.speech_text for r in built["Netherlands"].speeches.collect()] == ["Ja."] and [tuple(r) for r in built["Netherlands"].gaps.collect()] == [("R2", "report file missing")]
    sitting = '<dbtplenarprotokoll wahlperiode="20" sitzung-nr="5" sitzung-datum="%s"><rede id="I"><p klasse="redner"><redner id="1"><name><nachname>M</nachname></name></redner>x:</p><p>Ja.</p></rede></dbtplenarprotokoll>'
    german = spark.createDataFrame([(str(k), (sitting % day).encode(), '{"source_url": "u"}') for k, day in enumerate(("01.02.2020", "01.10.2026"))], "path string, content binary, known string")
    built["Germany"] = builders.germany({"archives": empty, "xml": german})
    assert [r.date for r in built["Germany"].speeches.collect()] == ["2026-10-01"]
    built["Spain"] = builders.spain({"html": empty, "lines": empty})
    built["Italy"] = builders.italy({"xml": empty, "html": empty})
    speeches, state = builders.combined(built)
    assert speeches.count() == 2 and not state["ready"] and "1 unresolved gaps of Netherlands" in state["blockers"]
    assert [tuple(r)[:4] for r in built["Germany"].counts().collect()] == [("Germany", 1, 1, 1)]


def test_controls_and_provenance(spark, tmp_path, capsys):
    passages = [{"country": "Italy", "text_language": "it", "generator": "m", "prompt_id": "1", "text": "Parole sagge."}]
    (tmp_path / "c.jsonl").write_text(json.dumps(passages[0]))
    assert commands.main(["controls", "--import-from", str(tmp_path / "c.jsonl"), "--output", str(tmp_path / "out.jsonl")]) == 0
    assert json.loads(capsys.readouterr().out)["records"] == 1 and spark.read.json(str(tmp_path / "out.jsonl")).first().speech_id == "positive-control-it-1"
    (tmp_path / "bad.jsonl").write_text(json.dumps(passages[0] | {"text_language": "fr"}))
    with pytest.raises(study.Refused, match="language"):
        commands.main(["controls", "--validate", str(tmp_path / "bad.jsonl")])
    raw = tmp_path / "raw" / "italy" / "leg19"
    raw.mkdir(parents=True)
    (raw / "sitting-12.xml").write_text("<x/>")
    (tmp_path / "m.jsonl").write_text(json.dumps({"local_path": "gone.xml", "sha256": "x", "source_url": "u"}) + "\n")
    assert commands.main(["provenance", "--raw", str(tmp_path / "raw"), "--manifest", str(tmp_path / "m.jsonl"), "--output", str(tmp_path / "n.jsonl")]) == 0
    assert json.loads(capsys.readouterr().out) == {"new": 1, "gone": 1}
    rows = {r.local_path: r for r in spark.read.json(str(tmp_path / "n.jsonl")).collect()}
    assert "idNumero=0012" in rows["italy/leg19/sitting-12.xml"].source_url and rows["gone.xml"].sha256 == "x"


def test_corpus_files_and_fingerprint(spark, tmp_path):
    from pyspark.sql import functions as F

    from plenaria.operators import quality

    df = files.mock_corpus(spark).withColumn("day", F.to_date("date"))
    outputs.write_corpus(df, str(tmp_path / "c.parquet"))
    back = spark.read.parquet(str(tmp_path / "c.parquet"))
    assert back.where("country = 'Spain' AND year = 2024").count() == 3
    columns = [c for c in df.columns if c != "country"]
    assert quality.fingerprint(back.select(columns)) == quality.fingerprint(df.select(columns).repartition(7)) != quality.fingerprint(df.select(columns).limit(35))
    assert quality.fingerprint(df.limit(0)) == "0:0:0"

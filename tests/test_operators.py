import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plenaria.functions import text as T
from plenaria.functions.countries import country_name
from plenaria.functions.deliveries import first_delivery, first_rows
from plenaria.functions.ranks import hash_prefix, unit_hash
from plenaria.operators import aggregate, controls, corpus, cost, provenance, quality, review, sampling, scoring


def values(spark, column, *data):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_words_and_forms(spark):
    assert values(spark, T.word_count, "L’intelligence artificielle — Grüße, Polska!", "Goedemorgen, collega’s.", None, "") == [4, 2, 0, 0]
    assert values(spark, T.normalized, "De  voorzitter : Geen steun.", None) == ["de voorzitter: geen steun.", None]
    assert values(spark, T.window_label, "AI-Assisted / Mixed", None, " ai_generated ") == ["ai-assisted-mixed", "", "ai-generated"]
    assert values(spark, lambda x: T.any_date(x).cast("string"), "2020-02-30", "2020-02-29", "01.02.2020", "1/2/2020", "20200201", "2020/02/01", "2020-02-01T10:00", "x", None) == [
        None, "2020-02-29", "2020-02-01", "2020-02-01", "2020-02-01", "2020-02-01", "2020-02-01", None, None]
    assert values(spark, country_name, " FR", "poland", "Atlantis", None) == ["France", "Poland", "Atlantis", None]


MINISTERS = ["Bundesminister der Finanzen", "Bundeskanzlerin", "ministre déléguée", "Premier ministre", "garde des sceaux", "minister-president, minister van Algemene Zaken", "staatssecretaris van Infrastructuur en Waterstaat", "minister", "Prezes Rady Ministrów"]
OTHERS = ["", "lid Tweede Kamer", "rapporteur", "floor_speaker", "Sekretarz Poseł", "Presidentschaft"]
CHAIRS = ["presiding_officer", "Präsident", "Präsidentin", "Präsident Dr. Wolfgang Schäuble", "Vizepräsidentin", "Wicemarszałek"]
NO_CHAIRS = ["Ministerpräsident (Bayern)", "président de la commission des finances", "voorzitter van de commissie", None]


def test_roles(spark):
    assert values(spark, T.is_minister, *MINISTERS, *OTHERS) == [True] * len(MINISTERS) + [False] * len(OTHERS)
    chair = lambda x: T.is_chair(x, F.lit(None).cast("string"))
    assert values(spark, chair, *CHAIRS, *NO_CHAIRS) == [True] * len(CHAIRS) + [False] * len(NO_CHAIRS)
    assert values(spark, lambda x: T.is_chair(F.lit(""), x), "Marszałek", "Anna Nowak") == [True, False]


def shares(spark, *data):
    df = spark.createDataFrame(data, "ai double, mixed double, windows array<struct<label:string,word_count:int>>")
    return [(r.s.ai, r.s.mixed) for r in df.select(scoring.shares(F.col("ai"), F.col("mixed"), F.col("windows")).alias("s")).collect()]


def test_response_shares(spark):
    got = shares(spark, (0.0, 0.0, [("AI-Generated", 30), ("Human Written", 80)]), (0.9, 0.0, [("AI-Generated", 3), ("AI-Assisted", 2), ("Human Written", 5)]),
                 (None, None, [("AI Generated", 25), ("AI-Assisted / Mixed", 15), ("Human Written", 60)]), (0.4, 0.1, [("AI Generated Text (v5)", 5), ("Written By A Human", 5)]), (0.4, 0.1, []), (0.4, 0.1, None), (0.4, 0.1, [("ai", 0)]))
    assert got == [(30 / 110, 0.0), (0.3, 0.2), (0.25, 0.15), (0.4, 0.1), (0.4, 0.1), (0.4, 0.1), (0.4, 0.1)]
    for bad in ((1.2, 0.0, None), (0.6, 0.6, None), (0.1, 0.1, [("ai", -1)])):
        with pytest.raises(Exception, match="between 0 and 1|exceed 1|negative"):
            shares(spark, bad)


SCORED = "speech_id string, country string, day date, words int, ai double, mixed double, party string, legislative_term string, speaker_id string, speaker_role string, speaker_name string"


def scored(spark, *data):
    import datetime

    rows = [(f"s{k}", c, datetime.date.fromisoformat(d), w, a, m, *more) for k, (c, d, w, a, m, *more) in enumerate(data)]
    return spark.createDataFrame([r + ("",) * (11 - len(r)) for r in rows], SCORED)


def test_weighted_shares(spark):
    df = scored(spark, ("Italy", "2024-01-02", 100, 0.5, 0.2), ("Italy", "2024-03-02", 300, 0.0, 0.1))
    (year,) = aggregate.by_period(df, "year").collect()
    assert (year.ai_word_share, year.mixed_word_share, year.ai_plus_mixed_word_share, year.speeches) == (0.125, 0.125, 0.25, 2.0)
    assert {(r.granularity, r.period) for r in aggregate.by_periods(df).collect()} == {("month", "2024-01"), ("month", "2024-03"), ("quarter", "2024-Q1"), ("year", "2024")}
    (weighted,) = aggregate.by_period(df.withColumn("sampling_weight", F.lit(2.5)), "year").collect()
    assert weighted.speeches == 5.0 and weighted.sampled_speeches == 2 and weighted.ai_word_share == 0.125
    with pytest.raises(Exception, match="invalid sampling weight"):
        aggregate.by_period(df.withColumn("sampling_weight", F.lit(0.0)), "year").collect()
    with pytest.raises(ValueError):
        aggregate.by_period(df, "week")
    assert aggregate.by_period(df.limit(0), "year").count() == 0


def test_sensitivity_and_baseline(spark):
    df = scored(spark, ("Spain", "2019-05-01", 100, 0.1, 0.0), ("Spain", "2024-05-01", 100, 0.5, 0.0, "", "", "", "ministra de Justicia"), ("Spain", "2024-06-01", 300, 0.2, 0.0), ("Poland", "2024-06-01", 60, 0.2, 0.0))
    got = {(r.min_words, r.excluded_role, r.country, r.period): r for r in aggregate.sensitivity(df).collect()}
    assert abs(got[40, "none", "Spain", "2024"].ai_word_share - 0.275) < 1e-12 and got[40, "ministers", "Spain", "2024"].ai_word_share == 0.2
    assert abs(got[250, "none", "Spain", "2024"].baseline_adjusted_ai_share_sensitivity - 0.1) < 1e-12
    assert got[40, "none", "Poland", "2024"].historical_baseline_ai_share is None and (100, "none", "Poland", "2024") not in got
    pooled = {(r.country, r.period_group): r.ai_word_share for r in aggregate.pre_post(aggregate.by_period(df, "year")).collect()}
    assert pooled["Spain", "pre-LLM control"] == 0.1 and len(pooled) == 3


def test_breakdowns(spark):
    rows = [("Germany", "2024-01-01", 100, 0.2 if k else 0.5, 0.0, "Test party", "20", "member-1") for k in range(11)] + [("Germany", "2024-01-01", 100, 0.2, 0.0, " ", "", "member-2")]
    got = aggregate.breakdowns(scored(spark, *rows)).collect()
    speakers = [r for r in got if r.dimension == "speaker"]
    assert len(speakers) == 1 and len(speakers[0].group) == 16 and abs(speakers[0].ai_word_share - (0.5 + 10 * 0.2) / 11) < 1e-9
    assert {r.group for r in got if r.dimension == "party"} == {"Test party", "__UNKNOWN__"} and {r.group for r in got if r.dimension == "length_band"} == {"100–249"}
    assert not [r for r in aggregate.breakdowns(scored(spark, *rows).withColumn("sampling_weight", F.lit(1.0))).collect() if r.dimension == "speaker"]


def test_cost(spark):
    df = scored(spark, ("Italy", "2019-01-01", 101, 0.0, 0.0), ("Italy", "2019-01-01", 101, 0.0, 0.0), ("France", "2024-01-01", 39, 0.0, 0.0), ("France", "2024-01-01", 40, 0.0, 0.0))
    got = {r.country: r for r in cost.estimate_cost(corpus.filtered(df)).collect()}
    assert (got["Italy"].estimated_api_units, got["Italy"].estimated_cost, got["France"].words, got["TOTAL"].estimated_api_units) == (4, 0.2, 40, 5)
    assert cost.estimate_cost(df.limit(0)).collect() == [("TOTAL", 0, 0, 0, 0.0)]
    assert cost.affordable_units(25.0, 0.5) == 500 and cost.affordable_units(0.3, 0.1) == 30 and not cost.within_cap(0.2, 0.1, 0.29) and cost.within_cap(0.1, 0.2, 0.3)
    with pytest.raises(ValueError):
        cost.estimate_cost(df, -1.0)
    assert corpus.filtered(df, "Italy", [2019]).count() == 2 and corpus.filtered(df, period="post").count() == 1


def study_rows(spark):
    import datetime

    data = [(f"{c}-{y}-{m}-{i}", c, datetime.date(y, m, 1), w) for c in ("France", "Poland") for y in range(2018, 2022) for m in (2, 9) for i, w in enumerate((50, 75, 120, 200, 300))]
    return spark.createDataFrame(data, "speech_id string, country string, day date, words int")


def test_budget_sample(spark):
    rows = study_rows(spark)
    plan = sampling.budget_plan(rows, 4.0, 0.5)
    found = plan.collect()
    assert len(found) == 16 and all(1 <= r.selected <= 5 for r in found)
    sample = sampling.stratified_sample(rows, plan)
    got = sample.collect()
    assert len(got) == sum(r.selected for r in found) and sum(-(-r.words // 100) for r in got) <= 80
    weights = {}
    for r in got:
        weights[r.stratum] = weights.get(r.stratum, 0) + r.sampling_weight
    assert all(abs(w - 5) < 1e-9 for w in weights.values())
    assert sorted(r.speech_id for r in got) == sorted(r.speech_id for r in sampling.stratified_sample(rows.repartition(9), plan).collect())
    with pytest.raises(ValueError, match="conservative minimum"):
        sampling.budget_plan(rows, 1.0, 0.5)
    everything = sampling.budget_plan(rows, 1000.0, 0.5).collect()
    assert all(r.selected == r.eligible and r.weight == 1.0 for r in everything)


def test_allocation_retires_what_does_not_fit():
    taken, reserved = sampling.allocate({"a": (3, 1, 3), "b": (3, 5, 15)}, 9)
    assert taken == {"a": 3, "b": 1} and reserved == 8


def controls_input(spark, parties=("A", "B")):
    import datetime

    data = [(f"{y}{p}{w}{i}", "Italy", datetime.date(y, 3, 1), w, p, f"sp{y}{p}{w}{i}") for y in range(2018, 2022) for p in parties for w in (80, 180) for i in range(2)]
    data += [("late", "Italy", datetime.date(2022, 1, 1), 80, "A", "z")] + [(f"zero{i}", "Italy", datetime.date(2018, 1, 1), 80, "A", "0") for i in range(2)]
    return spark.createDataFrame(data, "speech_id string, country string, day date, words int, party string, speaker_id string")


def test_historical_controls(spark):
    got = sampling.historical_controls(controls_input(spark), 8, seed=17, per_speaker=1).collect()
    assert len(got) == 8 == len({r.speaker for r in got}) and {r.year for r in got} == {2018, 2019, 2020, 2021} and "late" not in {r.speech_id for r in got}
    counts = {}
    for r in sampling.historical_controls(controls_input(spark, [f"P{k}" for k in range(20)]), 40, seed=4).collect():
        counts[r.year] = counts.get(r.year, 0) + 1
    assert max(counts.values()) - min(counts.values()) <= 1
    assert {"zero0", "zero1"} <= {r.speech_id for r in sampling.control_candidates(controls_input(spark)).collect()}
    with pytest.raises(ValueError):
        sampling.historical_controls(controls_input(spark), 0)


def test_review_sample_is_the_lowest_hashes(spark):
    import datetime
    import hashlib

    ids = [f"speech-{k:03d}" for k in range(200)]
    df = spark.createDataFrame([(i, "Spain", datetime.date(2020, 1, 1)) for i in ids], "speech_id string, country string, day date")
    best = sorted(ids, key=lambda i: hashlib.sha256(f"2026|{i}".encode()).hexdigest())[:10]
    assert sorted(r.speech_id for r in sampling.review_sample(df, "Spain", 10).collect()) == sorted(best)
    three = df.withColumn("day", F.add_months("day", 12 * F.pmod(F.xxhash64("speech_id"), F.lit(3)).cast("int")))
    got = [r.year for r in sampling.review_sample(three, "Spain", 6).collect()]
    assert {y: got.count(y) for y in got} == {2020: 2, 2021: 2, 2022: 2} and sampling.review_sample(df, "Italy", 3).count() == 0


def test_hash_prefix_is_the_sorted_prefix(spark):
    rng = random.Random(1)
    data = [(f"k{i}", "hot" if i % 4 else "cold", rng.randint(0, 9)) for i in range(3000)]
    budget = {"hot": 4000.0, "cold": 0.0}
    df = spark.createDataFrame([(*r, budget[r[1]]) for r in data], "id string, g string, n int, b double").withColumn("u", unit_hash("x", F.col("id")))
    for b in (0.0, 1.0, 4000.0, 1e9):
        rows = df.withColumn("b", F.lit(b))
        got = {r.id for r in hash_prefix(rows, ["g"], "u", F.col("n"), "b", "id").collect()}
        want, total = set(), {"hot": 0, "cold": 0}
        for r in sorted(rows.collect(), key=lambda r: (r.u, r.id)):
            total[r.g] += r.n
            if total[r.g] <= b:
                want.add(r.id)
        assert got == want


def test_first_delivery(spark):
    df = spark.createDataFrame([("a", "2024-01-02", "x"), ("a", "2024-01-01", None), ("a", None, "z"), ("b", None, "q"), (None, "2024-01-01", "n"), ("c", "2024-01-01", "y"), ("c", "2024-01-01", "x")], "id string, at string, v string").withColumn("at", F.to_timestamp("at"))
    got = {r.id: r.v for r in first_delivery(df, {"v": F.col("v")}, "id", "at").collect()}
    assert got == {"a": None, "b": "q", "c": "x"}
    assert {r.id: r.v for r in first_rows(df, {"v": F.col("v")}, "id", "at").collect()} == got and first_rows(df.limit(0), {"v": F.col("v")}, "id", "at").count() == 0


SPEECHES = "country string, date string, speech_id string, source_url string, source_identifier string, speech_text string, word_count int, delivered_at timestamp"


def test_audit(spark):
    data = [("France", "2020-01-01", "a", "u", "a", "Bonjour", 1, None), ("France", "2020-01-01", "b", "u", "b", "bonjour ", 1, None), ("Atlantis", "2020-1-1", "b", None, "b", "", 5, None)]
    report = quality.audit(spark.createDataFrame(data[:2], SPEECHES)).first()
    assert (report.duplicate_text_count, report.valid, report.words) == (1, True, 2)
    df = spark.createDataFrame(data, SPEECHES)
    assert not quality.audit(df).first().valid and len(quality.first_errors(df)) == 5
    with pytest.raises(ValueError, match="too many"):
        quality.first_errors(df, 3)
    assert quality.audit(df.limit(0)).first().valid


def test_gaps_and_coverage(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("x", 5), ("y", 7), ("x", None), ("x", 5)], "g string, n long")
    assert [tuple(r) for r in quality.number_gaps(df, ["g"], "n").collect()] == [("x", 3, 4)]
    assert {r.g: (r.expected, r.missing) for r in quality.number_coverage(df, ["g"], "n").collect()} == {"x": (5, 2), "y": (1, 0)}
    rows = spark.createDataFrame([("Italy", "2019-03-01")], "country string, day string").withColumn("day", F.to_date("day"))
    missing = quality.missing_coverage(rows, ("Italy", "Spain"), (2018, 2019))
    assert sorted((r.country, r.year) for r in missing.collect()) == [("Italy", 2018), ("Spain", 2018), ("Spain", 2019)]
    state = quality.readiness(missing, {"Germany": ["gap"], "Spain": None, "Italy": []})
    assert not state["ready"] and "gap report of Spain is missing" in state["blockers"] and not any("Germany" in b for b in state["blockers"])
    saved, again = spark.createDataFrame([(1, "a"), (2, "b")], "position int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "position int, v string")
    assert [r.position for r in quality.same_prefix(saved, again).collect()] == [2] and quality.same_prefix(saved.limit(0), again).count() == 0


def test_meetings(spark):
    ddl = "Id string, Datum string, Verslag array<struct<Id:string,Soort:string,Status:string,GewijzigdOp:string,Verwijderd:boolean>>"
    data = [("1", "2024-01-01", [("a", "Eindpublicatie", "Gecorrigeerd", "1", False), ("b", "Eindpublicatie", "Gerectificeerd", "2", False), ("c", "Eindpublicatie", "Gecorrigeerd", "3", True)]),
            ("2", "2024-02-01", [("d", "Tussenpublicatie", "Ongecorrigeerd", "1", False)]), ("3", "2024-03-01", []), ("4", "2024-03-01", None)]
    df = spark.createDataFrame(data, ddl)
    assert {r.Id: r.report for r in quality.selected_reports(df).collect()} == {"1": "b", "2": None, "3": None, "4": None}
    (r,) = quality.meeting_coverage(df).collect()
    assert (r.listed, r.selected, r.provisional_only, r.without) == (4, 1, 1, 2)


def test_containment(spark):
    source = "La señora presidenta: señorías, por favor, guarden silencio. (rumores). respeten a quien tiene la palabra y escuchen, que luego todos tendrán su turno en este debate."
    cases = [("guarden silencio.", source, "verified"), ("Señorías, por favor, guarden silencio. Respeten a quien tiene la palabra y escuchen, que luego todos tendrán su turno en este debate.", source, "partial"),
             ("n’ai", "je n'ai pas", "normalized"), ("Das ist ein fremder Satz.", source, "mismatch"), ("", source, "mismatch"), (None, None, "mismatch")]
    df = spark.createDataFrame([(str(k), a, b) for k, (a, b, _) in enumerate(cases)], "k string, text string, source string")
    got = {r.k: r.status for r in df.select("k", review.containment(F.col("text"), F.col("source")).alias("status")).collect()}
    assert [got[str(k)] for k in range(len(cases))] == [c[2] for c in cases]
    checked = review.verify(df.select("k", "text"), df.where("k = '0'").select("k", "source"), "k").collect()
    assert sum(r.status == "skipped" for r in checked) == len(cases) - 1


def test_occurrences_against_brute_force(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choices(["ja", "nein", "haus", "geld", "Straße", "öl"], k=rng.randint(0, 40)))) for i in range(150)]
    items = [(i, " ".join(texts[rng.randrange(150)][1].split()[2 : 2 + rng.randint(1, 8)])) for i in range(40)] + [(99, ""), (98, "fehlt ganz und gar hier drin")]
    got = {(r.item, r.key) for r in review.occurrences(spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(texts, "key int, text string")).collect()}
    low = lambda x: x.lower().replace("ß", "ss")
    assert got == {(i, k) for i, a in items for k, b in texts if a and low(a) in low(b)}


def test_provenance(spark):
    assert values(spark, provenance.content_type, "a/b.PDF", "x.tar", "y.json") == ["application/pdf", "application/octet-stream", "application/json"]
    assert values(spark, provenance.without_credentials, "https://x/y?a=1&API_KEY=s&b=2#f", "https://x/y?token=1", "https://x/y", None) == ["https://x/y?a=1&b=2", "https://x/y", "https://x/y", None]
    got = values(spark, provenance.source_address, "italy/leg19/sitting-12.xml", "poland/term-10/proceeding-3/2024-01-16/statement-4.html", "spain/term-14/DSCD-14-PL-59.html", "other/file")
    assert "idNumero=0012&idLegislatura=19" in got[0] and got[1].endswith("/term10/proceedings/3/2024-01-16/transcripts/4") and "legislatura=XIV&" in got[2] and got[3] is None
    assert values(spark, lambda u: provenance.query_part(u, "idPersona"), "https://x/y?idPersona=7") == ["7"]
    ddl = "source_url string, retrieved_at_utc string, local_path string, bytes long, sha256 string, content_type string, http_status int, retrieved_at_utc_basis string, provenance_status string"
    old = spark.createDataFrame([("u", "1", "a", 1, "h", "t", 200, None, "fetched"), ("u", "1", "b", 1, "h", "t", 200, None, None), ("u", "1", "c", 1, "h", "t", 200, None, None)], ddl)
    new = spark.createDataFrame([("u", "9", "a", 1, "h", "t"), ("u", "9", "b", 1, "h2", "t"), (None, "9", "d", 1, "h", "t")], "source_url string, retrieved_at_utc string, local_path string, bytes long, sha256 string, content_type string")
    got = {r.local_path: (r.change, r.retrieved_at_utc, r.retrieved_at_utc_basis, r.provenance_status) for r in provenance.reconcile(old, new).collect()}
    assert got == {"a": ("kept", "1", None, None), "b": ("changed", "9", "file_mtime", None), "c": ("gone", "1", None, None), "d": ("new", "9", "file_mtime", "unresolved_source_url")}


def test_controls(spark):
    ddl = "country string, text_language string, generator string, prompt_id string, text string, source_url string"
    good = ("Spain", "es", "test-llm", "p1", "Señor Presidente, esta enmienda mejora el texto.", None)
    bad = [("Spain", "es", " ", "p1", "x", None), ("Spain", "fr", "g", "p1", "x", None), ("Spain", "es", "g", "p1", "x", "u"), ("Atlantis", "es", "g", "p1", "x", None), ("Spain", "es", "g", "p1", "!!!", None)]
    kept, rest = controls.normalize(spark.createDataFrame([good, *bad], ddl))
    (r,) = kept.collect()
    assert (r.speech_id, r.word_count, r.synthetic_control) == ("positive-control-es-p1", 7, True)
    assert sorted(x.problem for x in rest.collect()) == sorted(["missing generator", "language does not match country", "source_url must stay empty", "unknown country", "text contains no words"])
    assert controls.missing_countries(kept).count() == 5
    found = controls.detections(kept, spark.createDataFrame([("positive-control-es-p1", 0.9, 0.05)], "speech_id string, fraction_ai double, fraction_ai_assisted double"))
    assert [(s.detection_rate, s.mean_ai_fraction) for s in controls.detection_summary(found).collect()] == [(1.0, 0.9)]
    with pytest.raises(ValueError):
        controls.brief("Atlantis")
    assert controls.brief("Poland")["text_language"] == "pl"


def test_scoring_sources(spark):
    df = spark.createDataFrame([("a",), ("b",)], "speech_id string")
    table = spark.createDataFrame([("a", 0.1, 0.2)], "speech_id string, ai double, mixed double")
    assert scoring.score(df, table).count() == 1
    with pytest.raises(Exception, match="no response for b"):
        scoring.score(df, table, must_match=True).collect()
    assert scoring.score(df, scoring.mock_shares(F.col("speech_id"))).count() == 2
    assert scoring.score(df, lambda d: d.withColumns({"ai": F.lit(1.0), "mixed": F.lit(0.0)})).first().ai == 1.0


def test_union_checks_countries(spark):
    df = spark.createDataFrame([("Italy",)], "country string")
    assert corpus.union_countries({"Italy": df}).count() == 1
    with pytest.raises(Exception, match="a row of Spain says Italy"):
        corpus.union_countries({"Italy": df, "Spain": df}).collect()


def test_key_filter_keeps_every_wanted_row(spark):
    from plenaria.functions.deliveries import first_rows, maybe_among

    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("key"), F.lit(1).alias("_n"))
    wanted = spark.range(1, 3000, 7).select(F.concat(F.lit("k"), "id").alias("w"))
    got = {r.key: r._maybe for r in maybe_among(rows, "key", wanted).collect()}
    assert all(got[f"k{k}"] for k in range(1, 3000, 7)) and got[None] is False and sum(got.values()) < 450
    assert not any(r._maybe for r in maybe_among(rows, "key", wanted.limit(0)).collect())
    ddl = "speech_id string, text string, delivered_at timestamp"
    at = lambda k: datetime(2024, 1, k)
    data = [("a", "late", at(2)), ("a", "first", at(1)), ("b", "only", None), (None, "x", at(1)), ("c", "no time", None), ("c", "timed", at(3))]
    found = first_rows(spark.createDataFrame(data, ddl), {"t": F.col("text")})
    assert sorted(found.collect()) == [("a", "first"), ("b", "only"), ("c", "timed")]
    assert first_rows(spark.createDataFrame([], ddl), {"t": F.col("text")}).count() == 0


def test_released_checkpoints_are_gone(spark):
    import os

    from plenaria.runtime import cut, release

    kept, gone = cut(spark.range(5)), cut(spark.range(7))
    place = gone._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(place)
    release(gone, spark.range(3))
    assert not os.path.exists(place) and kept.count() == 5


def test_gaps_across_spans(spark, monkeypatch):
    monkeypatch.setattr(quality, "SPAN", 10)
    rng = random.Random(3)
    data = [(g, k) for g in "ab" for k in rng.sample(range(-40, 200), 60)] + [("a", 500), ("c", 7), ("c", None)]
    want = set()
    for g in "abc":
        own = sorted({k for x, k in data if x == g and k is not None})
        want |= {(g, a + 1, b - 1) for a, b in zip(own, own[1:], strict=False) if b > a + 1}
    assert {tuple(r) for r in quality.number_gaps(spark.createDataFrame(data * 2, "g string, k int"), ["g"], "k").collect()} == want


def test_counts_of_states_and_warnings(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x")], "g string, s string")
    assert {r.g: (r.x, r.z, r.other) for r in quality.status_counts(df, ["g"], "s", ("x", "z")).collect()} == {"a": (1, 0, 2), "b": (1, 0, 0)}
    days = spark.createDataFrame([("b", "2017-01-01"), ("a", "2030-01-01"), ("c", "2020-01-01"), ("d", "x"), ("e", None)], "speech_id string, date string")
    assert [tuple(r) for r in quality.warnings(days, most=1).collect()] == [("a", "date outside configured study years: 2030-01-01")] and quality.warnings(days).count() == 2


def test_response_problems(spark):
    ddl = "stage string, error string, version string, fraction_ai double, fraction_ai_assisted double, fraction_human double"
    rows = [("complete", None, "v", 0.5, 0.3, 0.2), ("complete", None, "v", 0.9, 0.2, 0.0), ("complete", None, "v", None, 0.2, 0.0), ("complete", None, "v", 0.1, float("nan"), 0.0), ("complete", None, "w", 0.1, 0.1, 0.0), ("pending", None, "v", None, None, None), ("complete", "x", "v", None, None, None)]
    got = [r.p for r in spark.createDataFrame(rows, ddl).select(scoring.response_problem(("v",)).alias("p")).collect()]
    assert got == [None, "fractions sum to more than 1", "invalid fraction_ai", "invalid fraction_ai_assisted", "version isn't entitled", None, None]


def test_positions_and_fingerprints(spark):
    from plenaria.sources import files

    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    got = sampling.positioned(df.repartition(7), ["k"]).collect()
    assert sorted((r.position, r.k) for r in got) == [(k + 1, k) for k in range(500)] and sampling.positioned(df.limit(0), ["k"]).count() == 0
    texts = ["", 'a"b\\c/d', "".join(map(chr, range(32))) + "\x7fé😀", "\\u001F", None]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", files.fingerprints({"b": 1, "a": "ü"}, F.col("t")).alias("f")).collect()
    assert all(r.f == (None if r.t is None else files.request_fingerprint({"b": 1, "a": "ü"}, r.t)) for r in made)

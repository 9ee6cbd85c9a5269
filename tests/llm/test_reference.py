import random

import pytest

from plenaria.llm import reference_match as R


def test_join_is_exact(spark):
    rng = random.Random(5)
    make = lambda k: [(f"{k}{i}", "g", rng.sample("abcdefghijklmnop", rng.randint(1, 9))) for i in range(120)]
    left, right = make("l"), make("r")
    df = lambda rows: spark.createDataFrame([(g, i, t) for i, g, t in rows], "grp string, id string, tokens array<string>")
    for threshold in (0.4, 0.6, 1.0):
        got = {(r.left_id, r.right_id): r.score for r in R.similarity_join(df(left), df(right), threshold, ["grp"]).collect()}
        want = {}
        for i, _, a in left:
            for j, _, b in right:
                s = len(set(a) & set(b)) / len(set(a) | set(b))
                if s >= threshold:
                    want[i, j] = s
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


ENTRIES = [("Germany", "party", 1, "GAL"), ("Germany", "party", 1, "Grüne Alternative Liste"), ("Germany", "party", 2, "LKP"), ("Germany", "party", 2, "Liberale Küstenpartei"), ("Germany", "role", 3, "Abgeordnete"), ("France", "party", 4, "Liberale Küstenpartei"), ("Germany", "party", 9, None)]


def match(spark, *values, entries=ENTRIES):
    v = spark.createDataFrame([(c, f, x, "k") for c, f, x in values], "country string, field string, value string, id string")
    e = spark.createDataFrame(entries, "country string, field string, ref_id int, name string")
    return {(r.country, r.field, r.value): r.ref_id for r in R.match_values(v, e).collect()}


def test_typed_values(spark):
    typed = ["g.a.l.", "G A L", "Fraktion gal", "GAL - grune alternative liste", "Liste, Grüne Alternative", "GRÜNE ALTERNATIVVE LISTE *", "Grüne Alt. Lis.", "grn alternative liste (GAL)"]
    got = match(spark, *(("Germany", "party", x) for x in typed), ("Germany", "party", "Heimatliste Wiesstett"), ("Germany", "role", "Abgeodrnete i.V. / Ulm, 2020"), ("Germany", "role", "GAL"))
    assert [got["Germany", "party", x] for x in typed] == [1] * len(typed)
    assert got["Germany", "party", "Heimatliste Wiesstett"] == 0 == got["Germany", "role", "GAL"] and got["Germany", "role", "Abgeodrnete i.V. / Ulm, 2020"] == 3


def test_missing_ties_repeats_and_empty(spark):
    got = match(spark, ("Germany", "party", None), ("Germany", "party", ""), ("Germany", "party", "N/A"), (None, "party", "GAL"), ("Germany", "party", "GAL"), ("Germany", "party", "GAL"), ("Germany", "party", "..."), ("Germany", "party", "x" * 20_000))
    assert got == {(None, "party", "GAL"): 0, ("Germany", "party", "GAL"): 1, ("Germany", "party", "..."): 0, ("Germany", "party", "x" * 20_000): 0}
    tied = [("Germany", "party", 8, "Freie Liste"), ("Germany", "party", 7, "Freie Liste")]
    assert match(spark, ("Germany", "party", "freie liste"), entries=tied) == {("Germany", "party", "freie liste"): 7}
    assert match(spark) == {}
    assert match(spark, ("Germany", "party", "GAL"), entries=[]) == {("Germany", "party", "GAL"): 0}


def test_cut_off_words_have_as_many_readings_as_they_need(spark):
    # more continuations in the list than any fixed number, and more cut-off words in a value
    entries = [("Germany", "role", k, f"Vor{chr(97 + k % 26)}{chr(97 + k // 26)}sitzende des Ausschusses") for k in range(1, 60)]
    entries.append(("Germany", "role", 99, "Parlamentarische Staatssekretärin beim Bundesminister für Verkehr und Parlamentsfragen"))
    got = match(spark, ("Germany", "role", "Vorb. des Aussch."), ("Germany", "role", "Parl. Staatss. b. Bundesm. f. Verk. u. Parl."), entries=entries)
    assert got["Germany", "role", "Parl. Staatss. b. Bundesm. f. Verk. u. Parl."] == 99
    assert got["Germany", "role", "Vorb. des Aussch."] in {k for k in range(1, 60) if k % 26 == 1}
    assert R.readings("p. p. x", [["parlament", "partei"]]) == [["p", "p", "x"]]
    assert R.readings("pa. pa. x", [["parlament", "partei"], ["y"]]) == [["parlament", "partei", "x"], ["partei", "parlament", "x"]]

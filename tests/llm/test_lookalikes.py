import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plenaria.llm import lookalikes as L

ODD = set(map(chr, L.singles()))
plain = st.text(st.characters(exclude_categories=("Cs",), exclude_characters="".join(ODD)), max_size=12)


def one(text):
    return L.canonical_array(pa.array([text])).to_pylist()[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), plain), max_size=8))
def test_is_nfc_where_nothing_looks_alike(texts):
    got = L.canonical_array(pa.array(texts, pa.string())).to_pylist()
    for text, form in zip(texts, got, strict=True):
        expected = text if text is None else unicodedata.normalize("NFC", text)
        if expected is None or not set(unicodedata.normalize("NFD", text)) & ODD:
            assert form == expected


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=20))
def test_is_idempotent(text):
    assert one(one(text)) == one(text)


def test_what_looks_alike_becomes_equal():
    for a, b in [("ｃａｆｅ́", "café"), ("Ｂundestag", "Bundestag"), ("о​bra", "obra"), ("ﬁn", "fin"), ("a b", "a b"), ("a‑b", "a-b"), ("Ρaris", "Paris"), ("ĳs", "ijs"), ("Ӏӏүρ", "Ilyp"), ("ᎪᏴ", "AB"), ("ⅼⅷ", "lviii"), ("￥", "¥"), ("ǆ", "dž"), ("𝖠𝚋𝟢", "Ab0"), ("օս", "ou")]:
        assert one(a) == one(b)


def test_what_differs_visibly_stays_different():
    for a, b in [("cafe", "café"), ("a,b", "a b"), ("A", "a"), ("x²", "x2"), ("a\nb", "a b"), ("m", "n"), ("⅓", "1/3"), ("𝐀", "A"), ("ß", "ss")]:
        assert one(a) != one(b)


def test_marks_are_ordered_and_long_runs_done_whole():
    assert one("ạ́") == one("ạ́")
    long_ = "é" * 200_000 + "a" + "̖́" * 3000
    assert one(long_) == unicodedata.normalize("NFC", long_)


def test_slices_and_nulls_of_arrow_columns():
    column = pa.array(["x", None, "é", "", "日本"])
    assert L.canonical_array(column.slice(1, 3)).to_pylist() == [None, "é", ""]


DDL = "speech_id string, delivered_at timestamp, speech_text string, look string, _text int"


def rows(spark, data):
    return spark.createDataFrame([(i, None if at is None else np.datetime64(at).astype("datetime64[us]").item(), t, "x", 1) for i, at, t in data], DDL)


def test_pairs(spark):
    data = [("b", "2024-01-01", "obra"), ("a", "2024-01-01", "оbra"), ("c", "2024-01-01", "obra"), ("c", "2025-01-01", "other"), ("d", "2024-01-01", "Obra"),
            ("e", "2024-01-01", None), (None, "2024-01-01", "obra"), ("f", None, ""), ("f", "2024-01-01", "​"), ("g", "2024-01-01", "")]
    got = {tuple(r) for r in L.same_look_pairs(L.look_classes(rows(spark, data))).collect()}
    assert got == {("a", "b"), ("a", "c"), ("f", "g")}


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ａ", "keep")], "form int, t string, look string")
    assert [tuple(r) for r in L.canonical_text(df, "t", "out").collect()] == [(1, "ａ", "keep", "a")]
    assert [tuple(r) for r in L.canonical_text(df, "t", "t").collect()] == [(1, "a", "keep")]
    assert L.canonical_text(df.limit(0), "t", "out").count() == 0
    assert L.same_look_pairs(L.look_classes(rows(spark, []))).count() == 0


def test_classes(spark, tmp_path):
    data = [("b", "2024-01-01", "obra"), ("a", "2024-01-01", "оbra"), ("c", "2024-01-01", "obra"), ("d", "2024-01-01", "Obra"), ("e", None, None)]
    rows(spark, data).write.parquet(f"{tmp_path}/speeches.parquet")
    got = {r.speech_id: (r.look, r.speeches, r.kinds) for r in L.p4_classes(spark, str(tmp_path)).collect()}
    assert set(got) == set("abcd") and got["a"] == got["b"] == got["c"] and got["a"][1:] == (3, 2) and got["d"][1:] == (1, 1)

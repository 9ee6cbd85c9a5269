import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from plenaria.llm import tokens as T  # noqa: E402

JSON = T.VOCABULARY.replace(".tiktoken", ".json")


@pytest.fixture(scope="module")
def both():
    reference = tokenizers.Tokenizer.from_file(JSON)
    reference.encode_special_tokens = True
    with open(T.VOCABULARY, "rb") as file:
        return T.Encoder(file.read()), reference


def check(both, texts):
    enc, ref = both
    ids, at = enc.encode(texts)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == (ref.encode(text, add_special_tokens=False).ids if text else [])


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=("Cs",)), max_size=40)), max_size=6))
def test_like_the_public_library(both, texts):
    check(both, texts)


def test_long_pieces_and_markup(both):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdehnrst", k=rng.randint(2, 400))) for _ in range(200)]
    check(both, ["a" * 50_001, "ab" * 3000, " " * 999 + "x", "<|endoftext|>", "\r\n\n x", "é" * 500, " ".join(words), "", None, "ab" * 3000])


def test_forgetting_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(T, "REMEMBER", 3)
    check(both, ["one two three four five", "six seven"])
    check(both, ["one two three", "eight"])


def test_columns(spark):
    df = spark.createDataFrame([(1, "ein Wort", "x"), (2, None, None), (3, "", "y"), (1, "ein Wort", "x")], "doc_id long, text string, tokens string")
    got = T.encode_column(df, "text").collect()
    assert T.encode_column(df, "text").columns == ["doc_id", "tokens", "ids"]
    assert [(r.doc_id, len(r.ids) > 0) for r in got] == [(1, True), (2, False), (3, False), (1, True)] and got[1].ids == [] == got[2].ids
    counted = T.count_column(df.drop("tokens"), "text").collect()
    assert [r.tokens for r in counted] == [len(r.ids) for r in got]
    assert T.encode_column(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        T.count_column(df, "text")

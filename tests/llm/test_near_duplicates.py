import random
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import regex

from plenaria import runtime
from plenaria.llm import near_duplicates as D
from plenaria.llm.codepoints import to_points
from plenaria.llm.components import components
from plenaria.llm.words import occurrence_hashes, word_hashes

WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*")
DDL = "speech_id string, speech_text string, delivered_at timestamp, id long, bag string, key string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, 1, "x", "y") for i, t in texts], DDL)


def test_words_are_those_of_the_pattern():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abÉö0 .,'’-\n日😀́", k=rng.randint(0, 60))) for _ in range(400)] + ["", "'", "a'", "'a", "a''b", "l'eau d’or"]
    hashes, at = word_hashes(*to_points(pa.array(texts)), form=False)
    seen: dict[int, str] = {}
    for k, t in enumerate(texts):
        words = [w.lower() for w in WORD.findall(t)]
        got = hashes[at[k] : at[k + 1]].tolist()
        assert len(got) == len(words)
        for h, w in zip(got, words, strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_occurrences_make_bags_sets():
    hashes, at = word_hashes(*to_points(pa.array(["a b a a", "a a b a", "b a a", ""])))
    bags = [set(x) for x in np.split(occurrence_hashes(hashes, at), at[1:-1])]
    assert bags[0] == bags[1] and len(bags[0]) == 4 and bags[2] < bags[0] and not bags[3]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in {x for a, b in edges if a != b for x in (a, b)}}


def made(rng, n=90):
    return [f"w{rng.randint(0, 4000)}" for _ in range(n)]


def brute(texts):
    words = {i: [w.lower() for w in WORD.findall(t)] for i, t in texts if i and t}
    out = set()
    for a in words:
        for b in words:
            if a < b and min(len(words[a]), len(words[b])) >= 60 and words[a] != words[b]:
                common = sum((Counter(words[a]) & Counter(words[b])).values())
                if 2 * common >= 0.75 * (len(words[a]) + len(words[b])):
                    out.add((a, b))
    return out


def test_against_brute_force(spark):
    rng, texts = random.Random(6), []
    for k in range(120):
        base = made(rng, rng.randint(60, 200))
        texts.append((f"{k}", " ".join(base)))
        for v in range(rng.randint(0, 3)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                j = rng.randrange(len(w))
                w[j : j + rng.randint(0, 2)] = [rng.choice(w)] * rng.randint(0, 2)
            j = rng.randrange(len(w))
            texts.append((f"{k}-{v}", " ".join(w[j:] + w[:j]).upper()))
    got = {tuple(r) for r in D.NearDuplicates(table(spark, texts)).pairs().collect()}
    want = brute(texts)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_a_hot_group_and_exact_copies(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET", 4)
    rng = random.Random(7)
    base = made(rng, 200)
    texts = [(f"c{k}", " ".join(base)) for k in range(40)] + [(f"v{k}", " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 120, 4)] + [(f"o{k}", " ".join(made(rng))) for k in range(40)]
    found = D.NearDuplicates(table(spark, texts))
    member = {r.speech_id: (r.class_id, r.group_id) for r in found.membership().collect()}
    assert len({member[f"c{k}"][0] for k in range(40)}) == 1 and len({member[x][1] for x in member if x[0] in "cv"}) == 1
    assert all(member[f"o{k}"][1] is None for k in range(40))
    assert {tuple(r) for r in found.pairs().collect()} == brute(texts)


def test_what_takes_no_part(spark):
    base = " ".join(f"wort{k}" for k in range(60))
    texts = [(None, base), ("a", None), ("b", ""), ("c", "wort " * 59), ("d", base), ("e", base + " mehr"), ("e", "spät"), ("f", base.upper() + " mehr."), ("g", base + " mehr" + " lang" * 50_000)]
    found = D.NearDuplicates(table(spark, texts[:6] + texts[7:]))
    assert {tuple(r) for r in found.pairs().collect()} == {("d", "e"), ("d", "f")}
    empty = D.NearDuplicates(table(spark, texts).limit(0))
    assert empty.pairs().count() == 0 and empty.membership().count() == 0


def outer_version(rng):
    """A huge family of all but equal texts, and a version that is a duplicate of one of them only, not of its leaders."""
    base, other = made(rng, 200), [f"z{k}" for k in range(200)]
    outer = base[:147] + other[147:]
    family = [base[:k] + [f"f{k}"] + base[k + 1 :] for k in range(10, 130)]
    inner = base[:190] + other[190:195] + base[195:]
    return [(f"f{k}", " ".join(w)) for k, w in enumerate(family)] + [("inner", " ".join(inner)), ("outer", " ".join(outer))]


def test_the_only_link_of_an_outer_version_is_kept(spark, monkeypatch):
    texts = outer_version(random.Random(2))
    want = brute(texts)
    assert [p for p in want if "outer" in p] == [("inner", "outer")]
    assert {tuple(r) for r in D.NearDuplicates(table(spark, texts)).pairs().collect()} == want
    # the same without any broadcast, with many parts of a bucket and without the memory for copies
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "PART", 2)
    monkeypatch.setattr(D, "RECENT", 0)
    assert {tuple(r) for r in D.NearDuplicates(table(spark, texts + [("copy", texts[0][1])])).pairs().collect()} == brute([*texts, ("copy", texts[0][1])])


def test_leaders_spare_most_pairs_of_a_huge_group(spark, monkeypatch):
    texts = outer_version(random.Random(3))[:-2]
    counts, real = [], D.candidate_pairs

    def counted(reps, shared):
        out = real(reps, shared)
        counts.append(out[0].count())
        return out

    monkeypatch.setattr(D, "candidate_pairs", counted)
    monkeypatch.setattr(D, "BUCKET", 16)
    assert len(D.NearDuplicates(table(spark, texts)).pairs().collect()) == 120 * 119 // 2 > counts[0]


def test_versions_at_the_border_of_a_large_bucket(spark):
    """100 versions of a text with two words changed, and further texts that share 151 of 200 words with one of them each."""
    rng = random.Random(12)
    base = made(rng, 200)
    family = [[f"v{k}" if j in (k, k + 99) else w for j, w in enumerate(base)] for k in range(100)]
    outer = [family[k][:151] + [f"o{k}x{j}" for j in range(49)] for k in range(60)]
    texts = [(f"f{k}", " ".join(w)) for k, w in enumerate(family)] + [(f"o{k}", " ".join(w)) for k, w in enumerate(outer)]
    want = brute(texts)
    assert sum("o" in a + b for a, b in want) >= 60
    assert {tuple(r) for r in D.NearDuplicates(table(spark, texts)).pairs().collect()} == want


def test_words_are_counted_on_the_text_as_stored(spark):
    words = [f"wort{k}" for k in range(60)]
    split = "wo\u200brt0 " + " ".join(words[1:59])  # 60 words as stored, 59 in problem 4's form
    ab, cd = "\u00ad".join(["ab"] * 40), "\u00ad".join(["cd"] * 40)  # 40 words as stored, one in the form
    texts = [("a", split), ("b", " ".join(words)), ("c", " ".join(words[:59])), ("d", f"{ab} {cd}"), ("e", f"{cd} {ab}")]
    found = D.NearDuplicates(table(spark, texts))
    assert {r.speech_id for r in found.membership().collect()} == {"a", "b", "d", "e"}
    assert {tuple(r) for r in found.pairs().collect()} == {("a", "b"), ("d", "e")}


def test_only_first_deliveries_take_part(spark):
    base = " ".join(f"wort{k}" for k in range(60))
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [("d", base, early), ("e", base + " mehr", early), ("e", "spät", late), ("h", None, early), ("h", base + " auch", late), ("i", "kurz", early), ("i", base + " noch", late), ("k", base + " dann", late), ("k", "zeitlos", None)]
    found = D.NearDuplicates(spark.createDataFrame([(i, t, at, 1, "x", "y") for i, t, at in rows], DDL))
    assert {r.speech_id for r in found.membership().collect()} == {"d", "e", "k"}
    assert {tuple(r) for r in found.pairs().collect()} == {("d", "e"), ("d", "k"), ("e", "k")}

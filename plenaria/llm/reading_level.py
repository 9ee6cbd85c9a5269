"""Problem 10: the reading level of every document.

Each document gets syntax features (sentence and clause lengths, their spread, marks) and vocabulary features (word lengths,
long words, hashed word frequencies), the former set against the mean and spread of all documents of its language. A linear
ranker is fitted to graded document pairs by logistic loss; isotonic regression turns its scores on held-out documents into
expected grades, whose rounding gives the level.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.functions.ranks import unit_hash
from plenaria.llm.codepoints import pieces, to_points
from plenaria.llm.words import classes, mix, word_hashes
from plenaria.runtime import cut, release, small, table

MIN_WORDS = 30
LEVELS = (1, 2, 3, 4)
#: The ranker is fitted on at most this many graded documents, a hash sample of them if there are more.
GRADED = 20_000
#: Graded pairs in a fit.
PAIRS = 200_000
FOLDS = 4
SEED = 7
# Function words by which a text's language is told.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht wir ein eine mit auf den von zu für dem es im sich auch werden ich sie wird des",
    "fr": "le la les et est une un des du pour dans que qui ne pas sur au nous ce il vous plus par cette à de",
    "nl": "de het een en van is dat niet wij op te voor in zijn met aan er om die dit ook worden naar wordt al",
    "it": "il la di che e è un una per non con del della in i le si lo gli da al come questo sono dei nel",
    "es": "el la de que y en los del las por un una para con no es se lo al como más su nos este a",
    "pl": "i w na nie się że z do jest to o jak za co ten po dla tego od przez wobec gminie roku choć oraz",
}
LANGUAGES = [*FUNCTION_WORDS, "und"]
SYNTAX = ("sentence", "sentence_sd", "longest", "clause", "in_long", "comma", "semicolon", "colon", "bracket", "digit", "word", "word_sd", "len8", "len11", "len14", "short", "paragraph")
HASHED = 512


@functools.cache
def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all function words and, for each, in which languages it is."""
    hashes, languages = [], []
    for k, text in enumerate(FUNCTION_WORDS.values()):
        points, offsets = to_points(pa.array([text]))
        found = word_hashes(points, offsets)[0]
        hashes += found.tolist()
        languages += [k] * len(found)
    keys = np.unique(np.array(hashes, np.uint64))
    member = np.zeros((len(keys), len(FUNCTION_WORDS)))
    member[np.searchsorted(keys, np.array(hashes, np.uint64)), languages] = 1
    return keys, member / member.sum(axis=1, keepdims=True)


@functools.cache
def _marks() -> np.ndarray:
    """Of each code point: 1 sentence end, 2 comma, 3 semicolon, 4 colon, 5 bracket, 6 digit, 7 line end."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for k, chars in enumerate((".!?…。", ",،", ";", ":", "()[]", "0123456789", "\n\r  "), 1):
        out[[ord(c) for c in chars]] = k
    return out


def features(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, its language (index into LANGUAGES), syntax features and the counts of its hashed words."""
    n = len(offsets) - 1
    hashes, at = word_hashes(points, offsets, form=False)
    words = np.diff(at)
    syntax, language = np.zeros((n, len(SYNTAX)), np.float32), np.full(n, len(LANGUAGES) - 1)
    if not len(hashes):
        return words, language, syntax, np.zeros((n, HASHED), np.int64)
    kind, _ = classes()
    inside = kind[points] == 1
    mark = _marks()[points]
    rows_w = np.repeat(np.arange(n), words)
    keys, member = _function_hashes()
    spot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    known = np.flatnonzero(keys[spot] == hashes)
    votes = np.zeros((n, len(FUNCTION_WORDS)))
    np.add.at(votes, rows_w[known], member[spot[known]])
    language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), language)
    # places of words: letters run by run (an apostrophe ends a run here), merged into words by their starts
    edge = np.zeros(len(points), bool)
    edge[offsets[:-1][offsets[:-1] < len(points)]] = True
    run = inside & (~np.concatenate([[False], inside[:-1]]) | edge)
    starts = np.flatnonzero(run)
    letters = np.add.reduceat(inside.astype(np.int32), starts)
    rows_p = np.searchsorted(offsets, np.arange(len(points)), side="right") - 1
    rows_r = rows_p[starts]
    total = lambda sel: np.bincount(rows_p[sel], minlength=n).astype(np.float64)
    runs = np.maximum(np.bincount(rows_r, minlength=n), 1)
    safe = np.maximum(words, 1)
    # a mark ends a sentence if a blank or the end follows it
    after = np.append(points[1:], 32)
    last = np.append(edge[1:], True)
    stop = (mark == 1) & ((after <= 32) | last | (after == 0xA0))
    borders = stop | last | (mark == 7) & np.isin(after, [10, 13])
    piece = np.cumsum(borders) - borders
    per = np.bincount(piece[starts], minlength=int(piece[-1]) + 1)
    row_of = np.zeros(len(per), np.int64)
    row_of[piece] = rows_p
    per, row_of = per[per > 0], row_of[per > 0]
    count = np.maximum(np.bincount(row_of, minlength=n), 1)
    mean = np.bincount(row_of, per, n) / count
    clause = stop | last | (mark == 2) | (mark == 3) | (mark == 4)
    parts = np.cumsum(clause) - clause
    in_part = np.bincount(parts[starts], minlength=int(parts[-1]) + 1)
    part_row = np.zeros(len(in_part), np.int64)
    part_row[parts] = rows_p
    used = in_part > 0
    longest = np.zeros(n)
    np.maximum.at(longest, row_of, per)
    mean_word = np.bincount(rows_r, letters, n) / runs
    columns = {
        "sentence": np.log1p(mean),
        "sentence_sd": np.sqrt(np.maximum(np.bincount(row_of, per.astype(float) ** 2, n) / count - mean**2, 0)) / (mean + 1),
        "longest": np.log1p(longest),
        "clause": np.log1p(np.bincount(part_row[used], in_part[used], n) / np.maximum(np.bincount(part_row[used], minlength=n), 1)),
        "in_long": np.bincount(row_of, per * (per > 25), n) / runs,
        "comma": total(mark == 2) / safe,
        "semicolon": total(mark == 3) / safe,
        "colon": total(mark == 4) / safe,
        "bracket": total(mark == 5) / safe,
        "digit": total(mark == 6) / safe,
        "word": mean_word,
        "word_sd": np.sqrt(np.maximum(np.bincount(rows_r, letters.astype(float) ** 2, n) / runs - mean_word**2, 0)),
        "len8": np.bincount(rows_r, letters >= 8, n) / runs,
        "len11": np.bincount(rows_r, letters >= 11, n) / runs,
        "len14": np.bincount(rows_r, letters >= 14, n) / runs,
        "short": np.bincount(row_of, per * (per <= 7), n) / runs,
        "paragraph": np.log1p(words / (1 + total(mark == 7))),
    }
    for k, name in enumerate(SYNTAX):
        syntax[:, k] = columns[name]
    slot = (mix(hashes) % np.uint64(HASHED)).astype(np.int64)
    return words, language, syntax, np.bincount(rows_w * HASHED + slot, minlength=n * HASHED).reshape(n, HASHED)


def isotonic(scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of values over scores: its steps' score borders and values."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(scores[order].tolist(), values[order].tolist(), strict=True):
        pools.append([v, 1, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, m, _ = pools.pop()
            a, n, first = pools[-1]
            pools[-1] = [(a * n + b * m) / (n + m), n + m, first]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def fit_ranker(x: np.ndarray, grade: np.ndarray, penalty: float = 3e-4, rounds: int = 150, seed: int = SEED) -> np.ndarray:
    """Weights w so that x @ w ranks by grade: logistic loss over pairs of different grades, ridge penalty, accelerated descent."""
    rng = np.random.default_rng(seed)
    by = {g: np.flatnonzero(grade == g) for g in np.unique(grade)}
    if len(by) < 2:
        return np.zeros(x.shape[1])
    n = min(PAIRS, 60 * len(grade))
    a, b = rng.integers(0, len(grade), n), rng.integers(0, len(grade), n)
    keep = grade[a] != grade[b]
    a, b = a[keep], b[keep]
    a, b = np.where(grade[a] > grade[b], a, b), np.where(grade[a] > grade[b], b, a)
    weight = grade[a] - grade[b]
    weight = weight / weight.sum()
    x = np.ascontiguousarray(x, np.float32)
    back = np.ascontiguousarray(x.T)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 4.0 / max(1e-9, 2 * float(np.einsum("ij,ij->i", x, x).mean()))
    for k in range(rounds):
        s = x @ v
        p = weight / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        g = np.bincount(a, p, len(x)) - np.bincount(b, p, len(x))
        new = v + np.float32(step) * (back @ g.astype(np.float32) - np.float32(penalty) * v)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def design(z: np.ndarray, vocabulary: np.ndarray, share: float) -> np.ndarray:
    """Ranker inputs: the standardised syntax features, their products, and the hashed words weighted by share."""
    z = np.clip(z, -5, 5) / 3
    products = [z[:, [k]] * z[:, k:] for k in range(z.shape[1])]
    words = [vocabulary * share] if share else []
    return np.hstack([z, *products, *words]).astype(np.float32)


class Model:
    """The fitted ranker with its calibration. means, spreads: of the syntax features by language; center: of the hashed words."""

    #: Weights of the hashed words to choose from, by accuracy on held-out graded documents.
    SHARES = (0.0, 2.0, 4.0)
    PENALTY = 3e-3

    def __init__(self, means: np.ndarray, spreads: np.ndarray) -> None:
        self.means, self.spreads, self.fitted = means, spreads, False

    def _inputs(self, language: np.ndarray, syntax: np.ndarray, vocabulary: np.ndarray, share: float) -> np.ndarray:
        return design((syntax - self.means[language]) / self.spreads[language], vocabulary - self.center, share)

    def fit(self, language: np.ndarray, syntax: np.ndarray, vocabulary: np.ndarray, grade: np.ndarray) -> Model:
        if len(np.unique(grade)) < 2:
            return self
        self.center = vocabulary.mean(axis=0)
        fold = np.random.default_rng(SEED).permutation(len(grade)) % min(FOLDS, len(grade))
        best = -1.0
        for share in self.SHARES if len(grade) >= 50 else self.SHARES[:1]:
            x = self._inputs(language, syntax, vocabulary, share)
            held = np.zeros(len(grade))
            for f in range(int(fold.max()) + 1):
                train = fold != f
                s = x @ fit_ranker(x[train], grade[train], self.PENALTY).astype(np.float32)
                held[~train] = (s[~train] - s[train].mean()) / (s[train].std() + 1e-9)
            borders, values = isotonic(held, grade)
            right = (self._round(borders, values, held) == np.floor(grade + 0.5)).mean()
            if right > best:
                best, self.share, self.borders, self.values = right, share, borders, values
        self.accuracy = best
        x = self._inputs(language, syntax, vocabulary, self.share)
        self.weights = fit_ranker(x, grade, self.PENALTY).astype(np.float32)
        s = x @ self.weights
        self.shift, self.scale, self.fitted = s.mean(), s.std() + 1e-9, True
        return self

    @staticmethod
    def _round(borders: np.ndarray, values: np.ndarray, score: np.ndarray) -> np.ndarray:
        expected = values[np.clip(np.searchsorted(borders, score, side="right") - 1, 0, None)]
        return np.clip(np.floor(expected + 0.5), LEVELS[0], LEVELS[-1])

    def levels(self, language: np.ndarray, syntax: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
        s = (self._inputs(language, syntax, vocabulary, self.share) @ self.weights - self.shift) / self.scale
        return self._round(self.borders, self.values, s).astype(np.int32)


FEATURES = "_words int, _language int, _syntax binary, _counts binary"


def featured(documents: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents of at least min_words words without their text, with FEATURES: taken from the texts once and written.

    _syntax has the syntax features as 32-bit floats, _counts the slots and counts of the hashed words as pairs of 32-bit integers.
    """
    names = [c for c in documents.columns if c != text]
    spot = documents.columns.index(text)
    kinds = dict(x.split() for x in FEATURES.split(", "))
    schema = documents.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).schema

    def convert(batches):
        for batch in batches:
            for part in pieces(batch, spot, 300_000):
                words, language, syntax, counts = features(*to_points(part.column(spot)))
                keep = np.flatnonzero(words >= min_words)
                kept = part.take(pa.array(keep))
                row, slot = np.nonzero(counts[keep])
                pairs = np.stack([slot, counts[keep][row, slot]], axis=1).astype(np.int32)
                ends = np.searchsorted(row, np.arange(len(keep) + 1)) * pairs.itemsize * 2
                found = [
                    pa.array(words[keep], pa.int32()),
                    pa.array(language[keep], pa.int32()),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * len(SYNTAX)), len(keep), [None, pa.py_buffer(syntax[keep].tobytes())]).cast(pa.binary()),
                    pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(pairs.tobytes())]),
                ]
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(kept.columns) if k != spot), *found], names=schema.names)

    return cut(documents.mapInArrow(convert, schema))


def arrays(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, syntax features and hashed word frequencies of rows with FEATURES."""
    column = lambda c: table.column(table.schema.get_field_index(c))
    syntax = np.frombuffer(b"".join(column("_syntax").to_pylist()), np.float32).reshape(-1, len(SYNTAX))
    counts = column("_counts").to_pylist()
    pairs = np.frombuffer(b"".join(counts), np.int32).reshape(-1, 2)
    row = np.repeat(np.arange(len(counts)), [len(x) // 8 for x in counts])
    vocabulary = np.zeros((len(counts), HASHED), np.float32)
    vocabulary[row, pairs[:, 0]] = np.sqrt(pairs[:, 1] / np.maximum(column("_words").to_numpy(), 1)[row])
    return column("_language").to_numpy().astype(np.int64), syntax, vocabulary


def language_statistics(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each syntax feature by language over all rows with FEATURES. A few rows reach the driver."""

    def sums(batches):
        for batch in batches:
            language, every = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, len(SYNTAX))
            for k in np.unique(language).tolist():
                x = every[language == k].astype(float)
                yield pa.RecordBatch.from_pydict({"language": [k] * x.shape[1], "feature": list(range(x.shape[1])), "n": [len(x)] * x.shape[1], "s": x.sum(0).tolist(), "ss": (x**2).sum(0).tolist()})

    partial = rows.select("_language", "_syntax").mapInArrow(sums, "language long, feature long, n long, s double, ss double")
    got = partial.groupBy("language", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    means, spreads = np.zeros((len(LANGUAGES), len(SYNTAX))), np.ones((len(LANGUAGES), len(SYNTAX)))
    for r in got:
        means[r.language, r.feature] = r.s / r.n
        spreads[r.language, r.feature] = np.sqrt(max(r.ss / r.n - (r.s / r.n) ** 2, 0)) + 1e-6
    return means, spreads


def fit_levels(rows: DataFrame, labels: DataFrame, key: str = "doc_id", graded: int = GRADED) -> Model:
    """Fit the model. rows: key and FEATURES. Statistics are taken over all rows; the ranker sees at most about `graded` of the
    labelled ones.

    Labels without key or level or with a level outside 1 to 4 are left out, repeated rows count once, and a document's grade
    is the mean of its graders'. Labels of documents that aren't there don't matter.
    """
    model = Model(*language_statistics(rows))
    marks = labels.where(F.col("level").between(LEVELS[0], LEVELS[-1]) & F.col(key).isNotNull()).select(key, "grader", "level").distinct()
    grades = marks.groupBy(key).agg(F.avg("level").alias("_grade"))
    grades = cut(grades.withColumn("_unit", unit_hash("plenaria-levels", F.col(key))))
    n = grades.count()
    taken = grades.where(F.col("_unit") < graded / n) if n > graded else grades
    got = rows.join(small(taken, 64), key).select("_unit", "_grade", *(x.split()[0] for x in FEATURES.split(", "))).toArrow().sort_by("_unit")
    release(grades)
    return model.fit(*arrays(got), got["_grade"].to_numpy())


def reading_levels(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with FEATURES with level (int) in their place, added last: one row per document with enough words.

    A text in an unknown language is held against the other such texts. If no two grades were there to fit with, every level
    is null. A column called level already is a ValueError.
    """
    names = [c for c in rows.columns if c not in FEATURES.replace(",", "").split()]
    if "level" in names:
        raise ValueError("there is a column level already")
    schema = rows.select(*names).withColumn("level", F.lit(None).cast("int")).schema
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def convert(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part, m = batch.slice(begin, 2000), shared.value
                level = pa.array(m.levels(*arrays(part)), pa.int32()) if m.fitted else pa.nulls(len(part), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), level], names=schema.names)

    return rows.mapInArrow(convert, schema)


def _levels(spark, sf_dir, *columns: str) -> DataFrame:
    rows = featured(table(spark, sf_dir, "documents").select("doc_id", *columns, "text"))
    return reading_levels(rows, fit_levels(rows, table(spark, sf_dir, "level_labels")))


def p10_found(spark, sf_dir):
    return _levels(spark, sf_dir)


def p10_profile(spark, sf_dir):
    """Documents by source, language and level."""
    rows = _levels(spark, sf_dir, "source", "lang")
    source = F.lower(F.trim("source"))
    return rows.groupBy(source.alias("source"), F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang"), "level").agg(F.count(F.lit(1)).alias("documents"))

"""Problem 5: groups of texts that share most of their words but differ by small edits.

Texts with equal word sequences are one class. Class representatives get a MinHash signature of their word shingles; bands
of full minima give candidates, of which the low bits of all minima, packed into longs, estimate the similarity by bit
counts (corrected for chance agreement). Surviving candidates are verified exactly on word bags. Groups are the connected
components of the verified links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.deliveries import first_delivery, first_rows, maybe_among
from plenaria.llm.codepoints import pieces, to_points
from plenaria.llm.components import components
from plenaria.llm.words import mix, occurrence_hashes, word_counts, word_hashes
from plenaria.runtime import cut, release, small, table

SHINGLE = 4
BANDS, ROWS = 40, 4
LOW_BITS = 4
#: Least estimated shingle similarity of a candidate; versions with three quarters of their words in common, edited or
#: moved in a few places, have far more, texts of like wording but other content far less.
LEAST_ESTIMATE = 0.3
LEAST_COMMON = 0.75
MIN_WORDS = 60
#: So many word sequences a task remembers, to leave out the bands of copies.
RECENT = 50_000
#: Band buckets of more classes than this are first thinned by rounds with leaders.
BUCKET = 64
LEADERS = 8
#: Classes of a large bucket that one task rates against the others.
PART = 4096
#: A round that removes a smaller share than this ends the thinning: what is left is unlike each other.
THINNED = 0.1
#: Estimated similarity to a leader from which a class leaves its bucket.
ABSORB = 0.9

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLY, ADD = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash minima (rows x BANDS*ROWS, uint32) of the word shingles, of rows with fewer than SHINGLE words of the words;
    rows must have a word at least."""
    words = np.diff(offsets)
    n = np.where(words < SHINGLE, words, words - SHINGLE + 1)
    at = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    shingle = hashes[at].copy()
    whole = slice(None) if words.min() >= SHINGLE else np.repeat(words >= SHINGLE, n)
    at = at[whole]
    for k in range(1, SHINGLE):
        shingle[whole] = mix(shingle[whole]) + hashes[at + k]
    shingle = mix(shingle)
    starts = np.cumsum(n) - n
    out = np.empty((len(n), BANDS * ROWS), np.uint32)
    step = 1 << 16  # works in pieces that stay in the cache
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + step, side="right")) - 1)
        part = shingle[starts[begin] : starts[end] if end < len(n) else None]
        cuts = starts[begin:end] - starts[begin]
        for k in range(BANDS * ROWS):
            out[begin:end, k] = np.minimum.reduceat(((part * MULTIPLY[k] + ADD[k]) >> np.uint64(32)).astype(np.uint32), cuts)
        begin = end
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (the band's number goes into it)."""
    wide = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key + wide[:, :, r])
    return key.view(np.int64)


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of all minima, 16 to a long."""
    low = (minima & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint64)
    per = 64 // LOW_BITS
    low = low.reshape(len(minima), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(LOW_BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Estimated similarity of two packed signatures: share of equal low bits, less the share equal by chance."""
    longs = BANDS * ROWS * LOW_BITS // 64
    nibble = "bigint(1229782938247303441)"  # 0x1111...: the first bit of every four
    terms = []
    for k in range(longs):
        x = f"({a}[{k}] ^ {b}[{k}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        terms.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & {nibble})")
    differ = F.expr(" + ".join(terms)).cast("double")
    chance = 1 / (1 << LOW_BITS)
    return ((1 - differ / (BANDS * ROWS)) - chance) / (1 - chance)


def signed(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """key, seq (128 bits of the word sequence), sig, bands and row (unique) of the rows with enough words.

    The words of the text as stored must be enough; seq, sig and bands are those of its form, which must have a word. Where a
    task has met a sequence lately, bands is null: the bands of its earlier row stand for the copy.
    """
    # fewer characters than this can't be min_words words
    rows = df.where(F.char_length(text) >= 2 * min_words - 1).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.select("key", F.lit(None).cast("binary").alias("seq"), *(F.lit(None).cast("array<bigint>").alias(x) for x in ("sig", "bands"))).schema

    def convert(batches):
        met: dict[bytes, None] = {}
        for batch in batches:
            for part in pieces(batch, 1, 400_000):
                stored = to_points(part.column(1))
                hashes, offsets = word_hashes(*stored)
                enough = np.flatnonzero((word_counts(*stored) >= min_words) & (np.diff(offsets) > 0))
                n = np.diff(offsets)[enough]
                if not len(n):
                    continue
                index = np.repeat(offsets[enough] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hashes, offsets = hashes[index], np.append(0, np.cumsum(n))
                place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], n)).astype(np.uint64)
                seq = np.stack([np.add.reduceat(mix(hashes + mix(place + np.uint64(s))), offsets[:-1]) for s in (1, 1 << 40)], axis=1)
                new = np.ones(len(n), bool)
                for k, x in enumerate(map(bytes, seq)):
                    new[k] = x not in met
                    met[x] = None
                while len(met) > RECENT:
                    del met[next(iter(met))]
                minima = signatures(hashes, offsets)
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(new)).astype(np.int32) * BANDS), pa.array(band_keys(minima[new]).reshape(-1), pa.int64()), mask=pa.array(~new))
                sig = packed(minima)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(enough)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(seq.tobytes())]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sig.shape[1]), pa.array(sig.reshape(-1), pa.int64())),
                        bands,
                    ],
                    names=out.names,
                )

    return rows.mapInArrow(convert, out).withColumn("row", F.monotonically_increasing_id())


def bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and bag: the hashes of (word, occurrence) of each text."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def convert(batches):
        for batch in batches:
            for part in pieces(batch, 1, 400_000):
                hashes, offsets = word_hashes(*to_points(part.column(1)))
                found = occurrence_hashes(hashes, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found, pa.int64()))], names=["key", "bag"])

    return rows.mapInArrow(convert, rows.select("key", F.array(F.lit(0).cast("bigint")).alias("bag")).schema)


def shared_bands(signs: DataFrame, ids: DataFrame) -> DataFrame:
    """band, id, n: the classes of each band that more than one class has, and their number. ids: row, id.

    The bands of all rows are shuffled once, by band; counting and joining go on from there.
    """
    partitions = int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signs.where("bands IS NOT NULL").select("row", F.explode("bands").alias("band")).repartition(partitions, "band")
    met = rows.groupBy("band").agg(F.min("row").alias("_least"), F.max("row").alias("_most")).where("_least < _most").select("band")
    members = cut(rows.join(met.hint("shuffle_hash"), "band").select("band", "row"))
    found = members.join(ids, "row").select("band", "id").distinct()
    sizes = found.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = cut(found.join(sizes, "band"))
    release(members)
    return out


def candidate_pairs(reps: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of representatives that share a band and whose estimate is high enough, and the large buckets
    (band, id), of which more may be wanted. reps: id (long), sig. shared: band, id, n.

    In a bucket of a few classes every pair is rated. A large bucket may hold one huge group or many texts of like wording:
    its members are rated against a few leaders, those all but equal to a leader leave with the leaders, and so on until a
    round removes little. That finds most links of a huge group by few pairs; unlinked_pairs() rates what it leaves open.
    """
    sig = lambda name: reps.select(F.col("id").alias(name), F.col("sig").alias(f"sig_{name}"))

    def rated(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").where("a < b").distinct().join(sig("a"), "a").join(sig("b"), "b")
        return both.withColumn("estimate", estimate("sig_a", "sig_b")).where(F.col("estimate") >= LEAST_ESTIMATE).select("a", "b", "estimate")

    few = shared.where(F.col("n") <= BUCKET).select("band", "id")
    out = cut(rated(few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), "band")))
    many = large = shared.where(F.col("n") > BUCKET).select("band", "id")
    size = many.count()
    while size:
        leads = cut(many.groupBy("band", F.pmod("id", F.lit(LEADERS)).alias("k")).agg(F.min("id").alias("lead")).select("band", "lead"))
        versus = many.join(small(leads, 64), "band").where("id <> lead").select("band", "id", "lead")
        close = cut(rated(versus.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))))
        before, out = out, cut(out.unionByName(close).distinct())
        release(before)
        same = close.where(F.col("estimate") >= ABSORB)
        same = same.select(F.col("a").alias("id"), F.col("b").alias("lead")).unionByName(same.select(F.col("b").alias("id"), F.col("a").alias("lead")))
        gone = versus.join(same, ["id", "lead"], "left_semi").select("band", "id").unionByName(leads.select("band", F.col("lead").alias("id")))
        before, many = many, cut(many.join(gone, ["band", "id"], "left_anti"))
        release(leads, close, before)
        last, size = size, many.count()
        if size > last * (1 - THINNED):
            break
    release(many)
    return out, large


def unlinked_pairs(large: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct pairs a < b of one large bucket that no verified links connect yet and whose estimate is high enough.

    large: band, id. groups: id, component — by the verified links so far; a pair within a component is connected whatever
    its own similarity, every other pair of a bucket is rated inside the join, which hands on only the similar ones. Of a
    pair of two components one at least isn't of the bucket's largest, so a huge group is never joined with itself. The
    first side of a bucket is cut into salted parts of about PART classes, which spread over tasks.
    """
    members = cut(large.join(groups, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component")))
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where("k > 1")
    mixed = cut(mixed.select("band", F.col("top.component").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / PART).cast("int").alias("parts")))
    rows = members.join(small(mixed, 64), "band").join(reps, "id")
    side = lambda x: rows.select("band", "parts", F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("component").alias(f"of_{x}"), (F.col("component") == F.col("top")).alias(f"top_{x}"))
    a = side("a").where("NOT top_a").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int")).drop("parts")
    b = side("b").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    apart = (F.col("of_a") != F.col("of_b")) & (F.col("top_b") | (F.col("a") < F.col("b")))
    found = a.join(b, (a.band == b.band) & (a.part == b.part) & apart & (estimate("sig_a", "sig_b") >= LEAST_ESTIMATE))
    out = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(members, mixed)
    return out


def alike(pairs: DataFrame, contents: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose bags have a share of at least `least` in common. contents: id, bag."""
    side = lambda name: contents.select(F.col("id").alias(name), F.col("bag").alias(f"bag_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("bag_a", "bag_b"))
    return both.where(2 * common >= least * (F.size("bag_a") + F.size("bag_b"))).select("a", "b")


class NearDuplicates:
    """The classes, verified links and groups of a table of texts.

    key null: left out; text null, empty or of fewer than min_words words as stored: in no class. Repeated keys count by their first
    delivery. Exact copies (equal word sequences) are one class and take part as one. Extra columns don't matter.

    members: key, id — the class `id` (a long, unique) of each key. links: a, b — verified pairs of classes. groups: id,
    component — the classes that have a link, with the least class of their group. bags: id, bag of the linked classes.
    """

    def __init__(self, df: DataFrame, key: str = "speech_id", text: str = "speech_text", at: str = "delivered_at", min_words: int = MIN_WORDS, least: float = LEAST_COMMON) -> None:
        self.key, self.at = key, at
        self.texts = df.select(key, at, F.col(text).alias("_text"))
        signs = cut(signed(first_rows(self.texts, {"_text": F.col("_text")}, key, at), key, "_text", min_words))
        # a class is known by its 128 bits and numbered by its least row, so that no two are ever mixed up
        classes = signs.groupBy("seq").agg(F.min("row").alias("id"))
        self.members = cut(signs.select("key", "seq", "row").join(classes, "seq").select(F.col("key").alias(key), "id", "row"))
        shared = shared_bands(signs, self.members.select("row", "id"))
        reps = signs.select(F.col("row").alias("id"), "sig").join(shared.select("id").distinct(), "id", "left_semi")
        self.reps = cut(reps)
        release(signs)
        pairs, large = candidate_pairs(self.reps, shared)
        self.bags = self._bags(pairs)
        self.links = cut(alike(pairs, self.bags, least))
        release(pairs)
        self.groups = self._groups()
        rest = unlinked_pairs(large, self.reps, self.groups)
        if not rest.isEmpty():
            self.bags = cut(self.bags.unionByName(self._bags(rest, self.bags)))
            more = cut(alike(rest, self.bags, least))
            if not more.isEmpty():
                self.links = cut(self.links.unionByName(more))
                self.groups = self._groups()
        release(rest, shared)
        self.least = least

    def _bags(self, pairs: DataFrame, but: DataFrame | None = None) -> DataFrame:
        """id, bag of the classes in pairs. Only texts that may be wanted are taken to pieces, where they are."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        if but is not None:
            ids = ids.join(but, "id", "left_anti")
        wanted = cut(self.members.join(ids, (F.col("row") == ids.id)).select(ids.id, F.col(self.key).alias("key")))
        few = maybe_among(self.texts, self.key, wanted.select("key")).where("_maybe")
        texts = first_delivery(few, {"_text": F.col("_text")}, self.key, self.at)
        out = cut(bags(texts, self.key, "_text").join(small(wanted, 64), "key").select("id", "bag"))
        release(wanted)
        return out

    def _groups(self) -> DataFrame:
        return cut(components(self.links).select(F.col("node").alias("id"), "component"))

    def membership(self) -> DataFrame:
        """One row per key with enough words: key, class_id, group_id (null for a class without links)."""
        joined = self.members.join(self.groups, "id", "left")
        return joined.select(self.key, F.col("id").alias("class_id"), F.col("component").alias("group_id"))

    def class_pairs(self) -> DataFrame:
        """All verified pairs a < b of different classes of one group."""
        a = self.groups.select("component", F.col("id").alias("a"))
        b = self.groups.select("component", F.col("id").alias("b"))
        inside = a.join(b, "component").where("a < b").select("a", "b")
        return alike(inside, self.bags, self.least)

    def pairs(self) -> DataFrame:
        """The pairs of keys behind class_pairs, {key}_a < {key}_b."""
        k = self.key
        a = self.members.select(F.col("id").alias("a"), F.col(k).alias("_a"))
        b = self.members.select(F.col("id").alias("b"), F.col(k).alias("_b"))
        opened = self.class_pairs().join(a, "a").join(b, "b")
        return opened.select(F.least("_a", "_b").alias(f"{k}_a"), F.greatest("_a", "_b").alias(f"{k}_b"))


def p5_found(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "speeches")).pairs()


def p5_groups(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "speeches")).membership()

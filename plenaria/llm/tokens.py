"""Problem 8: encoding of a text column with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern. Each different piece is encoded once and remembered; unknown
pieces of a batch are encoded together: sorted by length into padded matrices of byte ids, in each round of which every
row merges its leftmost pair of minimum rank. Pairs are looked up in an open-addressing hash table, rows without a
mergeable pair leave the matrix. Long pieces are done one by one, all occurrences of their minimum pair in a round.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.llm.codepoints import pieces
from plenaria.runtime import table

#: Where the vocabulary lies on the driver; the workers get its contents (under 1 MB) with the task.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of more bytes than this are encoded one by one.
LONG = 128
#: Remembered pieces of a worker; when there are more, it begins anew. Only speed depends on it.
REMEMBER = 500_000
NONE = np.int32(2**31 - 1)


class Encoder:
    """Encoder for the vocabulary in the given file contents."""

    def __init__(self, contents: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in contents.splitlines() if line)}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        lefts, rights, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    merged.append(rank)
        keys = np.array(lefts, dtype=np.int64) << 20 | np.array(rights, dtype=np.int64)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        values, slot = np.array(merged, dtype=np.int32), self._slot(keys)
        while len(keys):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = keys[free]  # of those that want one slot the last one gets it
            placed = self.slots[slot] == keys
            self.ranks[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & (len(self.slots) - 1)
        self.find = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, NONE for those that don't merge."""
        keys = a.astype(np.int64) << 20 | b
        slot = self._slot(keys)
        seen = self.slots[slot]
        out = np.where(seen == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        flat_keys, flat_slot, flat_out = keys.reshape(-1), slot.reshape(-1), out.reshape(-1)
        if len(open_):
            open_ = np.flatnonzero(((seen != keys) & (seen >= 0)).reshape(-1))
        while len(open_):
            flat_slot[open_] = (flat_slot[open_] + 1) & (len(self.slots) - 1)
            seen = self.slots[flat_slot[open_]]
            hit = seen == flat_keys[open_]
            flat_out[open_[hit]] = self.ranks[flat_slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return flat_out.reshape(keys.shape)

    def matrix(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix of byte ids to the end. Returns the matrix and the rows' lengths."""
        out, sizes = ids.copy(), length.copy()
        rows = np.flatnonzero(length > 1)
        work = ids[rows]
        columns = np.arange(work.shape[1])
        valid = columns[1:] < length[rows][:, None]
        ranks = np.where(valid, self.pair_ranks(work[:, :-1], work[:, 1:]), NONE)
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                out[rows[done], : work.shape[1]] = work[done]
                rows, work, ranks, at, best = rows[~done], work[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            # compaction: all columns right of the merged pair move one to the left
            shift = columns[: work.shape[1] - 1] > at[:, None]
            work = np.where(shift, work[:, 1:], work[:, :-1])
            work[every, at] = best
            sizes[rows] -= 1
            if work.shape[1] == 1:
                out[rows, 0] = work[:, 0]
                break
            shift = columns[: work.shape[1] - 1] >= at[:, None]
            ranks = np.where(shift, ranks[:, 1:], ranks[:, :-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < sizes[rows])
            ranks[left, at[left] - 1] = self.pair_ranks(work[left, at[left] - 1], best[left])
            ranks[right, at[right]] = self.pair_ranks(best[right], work[right, at[right] + 1])
            end = np.flatnonzero((at + 1 >= sizes[rows]) & (at < ranks.shape[1]))
            ranks[end, at[end]] = NONE
        return out, sizes

    def long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long piece; in a round all occurrences of its pair of minimum rank, from the left."""
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ids) > 1:
            best = ranks.min()
            if best == NONE:
                break
            first = int(ranks.argmin())
            at = np.flatnonzero((ids[:-1] == ids[first]) & (ids[1:] == ids[first + 1]))
            if ids[first] == ids[first + 1]:  # in a run of equal ids every other pair merges
                run = np.cumsum(np.diff(at, prepend=-2) != 1)
                head = at[np.searchsorted(run, run)]
                at = at[(at - head) % 2 == 0]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids.copy()
            ids[at] = best
            ids = ids[keep]
            ranks = self.pair_ranks(ids[:-1], ids[1:])
        return ids

    def learn(self, new: list[str]) -> None:
        """Encode pieces that aren't known yet and remember them."""
        data = [x.encode() for x in new]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        results: list = [None] * len(data)
        for k in np.flatnonzero(sizes > LONG).tolist():
            results[k] = self.long(self.bytes[np.frombuffer(data[k], np.uint8)])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        begin = 0
        while begin < len(order):
            least = sizes[order[begin]]
            end = min(int(np.searchsorted(sizes[order], max(least + 2, least * 5 // 4), side="right")), begin + max(1, 2_000_000 // LONG))
            chosen = order[begin:end]
            width = int(sizes[chosen[-1]])
            padded = np.frombuffer(b"".join(data[k].ljust(width, b"\0") for k in chosen.tolist()), np.uint8).reshape(len(chosen), width)
            ids, lengths = self.matrix(self.bytes[padded], sizes[chosen])
            for k, row, n in zip(chosen.tolist(), ids, lengths.tolist(), strict=True):
                results[k] = row[:n]
            begin = end
        lengths = np.fromiter(map(len, results), np.int64, len(results))
        first, total = len(self.known), self.used + int(lengths.sum())
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(new) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : total] = np.concatenate(results)
        self.sizes[first : first + len(new)] = lengths
        self.starts[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used = total
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them."""
        if len(self.known) > REMEMBER:
            self._forget()
        found, edges = [], np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                found += self.find(text)
            edges[k + 1] = len(found)
        new = [x for x in dict.fromkeys(found) if x not in self.known]
        if new:
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        sizes = self.sizes[index].astype(np.int64)
        ends = np.zeros(len(index) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        ids = self.flat[np.repeat(self.starts[index] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[edges]


_ENCODERS: dict[str, Encoder] = {}


def encoder(contents: bytes) -> Encoder:
    """This process's encoder for a vocabulary."""
    key = hashlib.sha1(contents).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(contents)
    return _ENCODERS[key]


def _mapped(df: DataFrame, text: str, out: str, kind: str, vocabulary: str, make) -> DataFrame:
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    names, spot = [c for c in df.columns if c != text], df.columns.index(text)
    schema = df.select(*names).withColumn(out, F.lit(None).cast(kind)).schema

    def convert(batches):
        enc = encoder(shared.value)
        for batch in batches:
            for part in pieces(batch, spot):
                ids, offsets = enc.encode(part.column(spot).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != spot), make(ids, offsets)], names=schema.names)

    return df.mapInArrow(convert, schema)


def encode_column(df: DataFrame, text: str, out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with its text column replaced by the token ids as array<int> column `out`, added last.

    No special tokens are made; markup-like strings are ordinary text. Null and empty texts give an empty list. Texts of
    any length are encoded whole. Other columns, repeated rows and empty tables come through as they are; a column that is
    already called `out` is a ValueError. Rows aren't moved between tasks.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    return _mapped(df, text, out, "array<int>", vocabulary, lambda ids, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32())))


def count_column(df: DataFrame, text: str, out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with its text column replaced by its number of tokens as bigint; 0 for null and empty texts."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    return _mapped(df, text, out, "bigint", vocabulary, lambda ids, at: pa.array(np.diff(at), pa.int64()))


def p8_ids(spark, sf_dir):
    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")

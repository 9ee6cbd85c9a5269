"""Whether a record's text is in its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.text import LOOSE, normalized

HEAD = 160
SEGMENT, LONE_SEGMENT, FOUND = 25, 80, 0.9


def containment(record: Column, source: Column) -> Column:
    """verified, normalized, partial or mismatch. Null texts are empty; an empty record is a mismatch.

    Both texts are normalized once a row; what later tests need is made of these forms, and only where it comes to them.
    """
    forms = F.struct(normalized(F.coalesce(record, F.lit(""))).alias("needle"), normalized(F.coalesce(source, F.lit(""))).alias("hay"))
    return F.get(F.transform(F.array(forms), lambda x: _status(x["needle"], x["hay"])), F.lit(0))


def _status(needle: Column, hay: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, LOOSE, "")
    tail = F.when(F.char_length(needle) > HEAD, F.substring(needle, -HEAD, HEAD)).otherwise(needle)
    segments = F.filter(F.transform(F.split(needle, r"[.!?;:]\s+"), F.trim), lambda s: F.char_length(s) >= SEGMENT)
    found = F.size(F.filter(segments, lambda s: F.contains(hay, s)))
    enough = (F.size(segments) > 0) & (found >= F.size(segments) * FOUND) & ((F.size(segments) > 1) | (F.char_length(F.get(segments, F.lit(0))) >= LONE_SEGMENT))
    return (
        F.when(needle == "", "mismatch")
        .when(F.contains(hay, needle), "verified")
        .when((bare(needle) != "") & F.contains(bare(hay), bare(needle)), "normalized")
        .when(F.contains(hay, F.substring(needle, 1, HEAD)) | F.contains(hay, tail), "partial")
        .when(F.coalesce(enough, F.lit(False)), "partial")
        .otherwise("mismatch")
    )


def verify(records: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """records (key, text) joined with their sources (key, source): all of records' columns and status, 'skipped' without a source."""
    joined = records.join(sources.select(key, "source"), key, "left")
    return joined.withColumn("status", F.when(F.col("source").isNull(), "skipped").otherwise(containment(F.col("text"), F.col("source")))).drop("source")


def occurrences(items: DataFrame, texts: DataFrame, words: int = 3) -> DataFrame:
    """item, key of the texts that contain an item word for word (normalized).

    items: item, text. texts: key, text. Texts and items meet by the rarest word run of each item: every run of `words` words
    of the texts is looked up among the items' rarest ones, which is an equi join; the few candidates are then searched. Items
    of fewer words are looked up by all of their words.
    """
    # the first and last word of an item may be cut off, so only whole runs inside of it are keys; short items use contains
    split = lambda t: F.split(normalized(t), r"[^\p{L}\p{N}]+")
    runs = lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.array_join(F.slice(w, i + 1, words), " ")))
    own = items.select("item", normalized(F.col("text")).alias("_needle"), runs(F.slice(split(F.col("text")), F.lit(2), F.greatest(F.size(split(F.col("text"))) - 2, F.lit(1)))).alias("_runs")).where("_needle <> ''")
    all_runs = texts.select("key", F.explode(F.array_distinct(runs(split(F.col("text"))))).alias("_run"))
    keyed = own.where("_runs IS NOT NULL").select("item", F.explode(F.array_distinct("_runs")).alias("_run"))
    counts = all_runs.join(keyed.select("_run").distinct(), "_run", "left_semi").groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    rare = keyed.join(counts, "_run", "left").groupBy("item").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("r")).select("item", F.col("r._run").alias("_run"))
    pairs = rare.join(all_runs, "_run").select("item", "key").distinct()
    close = pairs.join(own.select("item", "_needle"), "item").join(texts.select("key", normalized(F.col("text")).alias("_hay")), "key")
    found = close.where(F.contains("_hay", "_needle")).select("item", "key")
    short = own.where("_runs IS NULL").select("item", "_needle")
    # items too short for a run: every text is searched for each of them, a stated list against all rows
    rest = texts.select("key", normalized(F.col("text")).alias("_hay")).join(F.broadcast(short), F.contains("_hay", "_needle")).select("item", "key")
    return found.unionByName(rest)

"""First deliveries: one row per key, the earliest delivered one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "9999-12-31"
#: Bits of a key filter, in rows of ROW_BITS: with 8 MB at most it may always be broadcast.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def first_delivery(df: DataFrame, columns: dict[str, Column], key: str = "speech_id", at: str = "delivered_at") -> DataFrame:
    """key and columns of the row of each key with the earliest time.

    A null time counts as latest; equal times are settled by the values of the columns in their order, so the result
    does not depend on the order of the rows. Rows without key are left out. The aggregation combines on the map side.
    """
    packed = F.struct(F.coalesce(F.col(at), F.lit(LATE).cast("timestamp")).alias("_at"), *[c.alias(n) for n, c in columns.items()])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(F.min(packed).alias("_first"))
        .select(key, *[F.col(f"_first.{n}").alias(n) for n in columns])
    )


def maybe_among(df: DataFrame, key: str, keys: DataFrame, out: str = "_maybe") -> DataFrame:
    """df with a boolean column `out`: false only if a row's key is surely not one of `keys` (a frame of one column), or null.

    The keys set bits in a bitmap of fixed size, aggregated on the map side and broadcast whatever their number; the more
    there are, the more other rows are true too. So a filter by `out` leaves every row that an exact join would find.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    spots = keys.select(place(F.col(keys.columns[0])).alias("_place"))
    row = F.floor(F.col("_place") / ROW_BITS).alias("_row")
    bitmap = spots.groupBy(row).agg(F.bitmap_construct_agg(F.col("_place") % ROW_BITS).alias("_bits"))
    placed = df.withColumn("_place", place(F.col(key))).withColumn("_row", F.floor(F.col("_place") / ROW_BITS))
    joined = placed.join(F.broadcast(bitmap), "_row", "left")
    spot = F.col("_place") % ROW_BITS
    byte = F.conv(F.hex(F.substring("_bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte.cast("bigint"), (spot % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(out, hit & F.col(key).isNotNull()).drop("_place", "_row", "_bits")


def first_rows(df: DataFrame, columns: dict[str, Column], key: str = "speech_id", at: str = "delivered_at") -> DataFrame:
    """The same as first_delivery for wide columns: only the rows of keys that were delivered again are shuffled with them.

    Those keys are found in a pass over key alone; a key filter tells the rows that surely have none of them, which stay
    where they are.
    """
    rows = df.where(F.col(key).isNotNull())
    again = rows.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    marked = maybe_among(rows, key, again)
    once = marked.where("NOT _maybe").select(F.col(key), *[c.alias(n) for n, c in columns.items()])
    return once.unionByName(first_delivery(marked.where("_maybe"), columns, key, at))

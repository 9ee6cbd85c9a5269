"""Problem 6: a sample that is the same for any rerun, row order or partitioning, and only grows as data grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.functions.deliveries import first_delivery
from plenaria.functions.ranks import DIGITS, unit_hash
from plenaria.runtime import table

SALT = "plenaria-sample-1"
RATE = 0.1


def stable_sample(df: DataFrame, columns: list[str], rate: float = RATE, salt: str = SALT, key: str = "speech_id", at: str = "delivered_at") -> DataFrame:
    """The keys whose salted hash lies below rate, each once, with the given columns of its first delivery.

    A key is in or out by its own hash alone, so reruns, partitionings and row orders don't matter, later deliveries never
    remove a selected key, and a sample of a lower rate is part of one of a higher rate. The rows are filtered before
    anything is shuffled. Rows with a null key are never selected; an empty key is a key; null columns stay null; an empty
    table gives an empty sample. rate 0 selects nothing and rate 1 every key.
    """
    if not 0 <= rate <= 1:
        raise ValueError(f"rate {rate} is not in [0, 1]")
    kept = df.where(F.col(key).isNotNull() & (unit_hash(salt, F.col(key)) < F.lit(float(rate))))
    return first_delivery(kept, {c: F.col(c) for c in columns}, key, at)


def p6_sample(spark, sf_dir):
    return stable_sample(table(spark, sf_dir, "speeches"), ["country", "date"])


SQL = {
    "p6_sample": f"""
        SELECT speech_id, f.country AS country, f.date AS date FROM (
          SELECT speech_id, min({{'at': coalesce(delivered_at, TIMESTAMP '9999-12-31'), 'country': country, 'date': date}}) AS f
          FROM speeches
          WHERE speech_id IS NOT NULL
            AND CAST('0x' || substr(sha256('{SALT}|' || speech_id), 1, {DIGITS}) AS BIGINT) / {float(16**DIGITS)} < {RATE}
          GROUP BY speech_id)""",
}

"""Streaming queries over the events table, each run over what is there (available now) with the result of its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.runtime import cut, scratch

#: So late an event may be and still count; the table is read in one go, so its events come within this time.
DELAY = "3650 days"


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of files."""
    shape = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(d)


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote: the rows of all batches with `batch`."""
    spark = stream.sparkSession
    with scratch(spark) as folder:

        def write(rows: DataFrame, batch: int) -> None:
            # one folder per batch: a batch that is run again replaces its own rows
            rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/{batch}")

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return cut(spark.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{folder}/out"))


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of updated rows the last one of each key."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def stream_daily_events(spark, d):
    """Events and values by day and type, with a watermark."""
    rows = event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)
    sums = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.round("value", 6).cast("decimal(18,6)")).alias("total"))
    flat = sums.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.col("total").cast("double").alias("total"))
    return latest(run(flat, "update"), ["day", "event_type"])


def distinct_within(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = DELAY) -> DataFrame:
    """The first row of each key; a key's state ends when the watermark has passed it by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_distinct_events(spark, d):
    """Every pair of user and type once, however often it comes."""
    rows = distinct_within(event_stream(spark, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"])
    return run(rows, "append").select("user_id", "event_type")


def stream_filtered_events(spark, d):
    """A stateless stream: the events of a type with their parsed property."""
    rows = event_stream(spark, d).where("event_type = 'purchase'")
    return run(rows.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")), "append").select("event_id", "k")


QUERIES = {f.__name__: f for f in (stream_daily_events, stream_distinct_events, stream_filtered_events)}
SQL = {
    "stream_daily_events": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, CAST(sum(CAST(round(value, 6) AS DECIMAL(18,6))) AS DOUBLE) AS total
        FROM events GROUP BY ALL""",
    "stream_distinct_events": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_filtered_events": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'",
}

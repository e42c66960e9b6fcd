"""Structured Streaming: windows over events, exactly-once records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.session import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with an event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there (``availableNow``), into files of the
    shared folder with a checkpoint beside them, and return what it wrote."""
    spark = stream.sparkSession
    at = scratch(spark, name)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        put = lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/out")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def windowed(events: DataFrame, width: str, slide: str | None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by window and type."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user: events with no more than ``gap`` between them."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("user_id", "first", "last", "n")


def once(records: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Records without repetition of their key within the watermark."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])

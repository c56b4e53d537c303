"""The event log as a stream: rolling rates, events without repeats, the log as files. Windows and watermarks are extensions of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; the time is made a timestamp, since watermarks take no other type."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("at", F.col("ts").cast("timestamp")).withColumn("page_num", F.get_json_object("props", "$.k").cast("long"))


def rolling_rate(events: DataFrame, late: str = "10 minutes", size: str = "60 seconds", slide: str = "20 seconds") -> DataFrame:
    """Calls and tokens of each stage in sliding windows; events later than the watermark are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", size, slide), "event_type").agg(F.count("*").alias("calls"), F.sum("page_num").alias("tokens"))


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats, remembered as long as the watermark allows."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """The log as files, appended exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streaming queries: each must give what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans import timeline
from loomline.session import table
from loomline.streaming.run import drain
from loomline.streaming.stateful import adaptive_sample_stream, keep_changed_stream


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as the table may be one file: a plain path must be a folder for a stream
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def stream_dedup_equiv(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "ocr_event").select(F.col("video_id").alias("video"), F.col("event_id").alias("seq"), F.col("timestamp_s").alias("timestamp"), "text")
    return drain(keep_changed_stream(rows, 0.45, 20.0)).select("video", "seq")


def stream_sampling_equiv(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events").select(F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("video"), F.col("event_id").alias("seq"), (F.col("event_id") / 10).alias("timestamp"), (F.col("value") / 100).alias("value"))
    return drain(adaptive_sample_stream(rows, threshold=0.5)).select("video", "seq", F.round("difference", 6).alias("difference"))


QUERIES = {"stream_dedup_equiv": stream_dedup_equiv, "stream_sampling_equiv": stream_sampling_equiv}
SQL = {"stream_dedup_equiv": timeline.SQL["ocr_dedup_keep_last"], "stream_sampling_equiv": timeline.SQL["adaptive_sampling"]}

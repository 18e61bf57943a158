"""Stage state and resumption: what is done, what changed, what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.fixed import STAGES


#: Statuses from least to most advanced.
PROGRESS = ["pending", "running", "partial", "complete"]


def identities(files: DataFrame) -> DataFrame:
    """(path, size_bytes, modified_at, head_hash) of binaryFile rows: the hash covers the first 8 KiB."""
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").cast("string").alias("modified_at"), head_hash("content").alias("head_hash"))


def head_hash(content):
    return F.substring(F.sha2(F.substring(F.col(content).cast("binary"), 1, 8192), 256), 1, 16)


def changed(now: DataFrame, stored: DataFrame, key: str = "video") -> DataFrame:
    """Keys whose size, time or head differs from what is stored, or that aren't stored; the path doesn't matter."""
    same = ["size_bytes", "modified_at", "head_hash"]
    return now.join(stored.select(key, *same), [key, *same], "left_anti").select(key).distinct()


def left_to_do(videos: DataFrame, state: DataFrame, stage: str, force: bool = False, key: str = "video") -> DataFrame:
    """Keys whose ``stage`` isn't complete."""
    done = state.filter((F.col("stage") == stage) & (F.col("status") == "complete")).select(key)
    return videos.select(key).distinct() if force else videos.select(key).distinct().join(done, key, "left_anti")


def stage_report(videos: DataFrame, state: DataFrame, key: str = "video") -> DataFrame:
    """(key, report, n_complete): each stage's status in fixed order; one that isn't recorded is pending.

    Of a stage recorded several times, the most advanced status counts.
    """
    known = F.col("stage").isin(*STAGES)
    per_stage = state.filter(known).groupBy(key, "stage").agg(F.max_by("status", F.array_position(F.lit(PROGRESS), F.col("status"))).alias("status"))
    latest = per_stage.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("known"))
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.try_element_at("known", F.lit(s)), F.lit("pending")).alias("status")) for s in STAGES])
    rows = videos.select(key).distinct().join(latest, key, "left").withColumn("stages", stages)
    text = F.array_join(F.transform("stages", lambda x: F.concat(x["stage"], F.lit("="), x["status"])), " ")
    return rows.select(key, text.alias("report"), F.size(F.filter("stages", lambda x: x["status"] == "complete")).alias("n_complete"))


def passed_before(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to skip: a passed transcript with equal settings exists."""
    return wanted.join(done.filter("status = 'passed'").select(*keys).distinct(), keys, "left_semi")


def pick_caption_file(files: DataFrame) -> DataFrame:
    """(video, name): of each video's downloaded files, .vtt before others, then by name; partial downloads don't count."""
    rows = files.filter(~F.col("name").rlike(r"\.(part|ytdl)$"))
    return rows.groupBy("video").agg(F.min_by("name", F.struct((~F.col("name").endswith(".vtt")).alias("other"), "name")).alias("name"))


def pick_cached_audio(files: DataFrame) -> DataFrame:
    """(video, name): the first of each video's cached audio files by name; partial downloads and captions don't count."""
    rows = files.filter(~F.col("name").rlike(r"\.(part|ytdl|vtt|srt|json)$"))
    return rows.groupBy("video").agg(F.min("name").alias("name"))


def save(state: DataFrame, path: str) -> None:
    """Overwrite only the partitions of the videos in ``state``: writing again after a lost job gives the same."""
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(path)

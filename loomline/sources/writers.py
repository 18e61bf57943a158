"""Writers: JSON, JSON lines, subtitles, Markdown and HTML as partitioned text; Parquet is the internal store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import format_time
from loomline.operators import captions


def write_documents(documents: DataFrame, path: str, keys: list[str]) -> None:
    """(keys, document) as text files under key=<value> folders; rerunning replaces those of the keys written."""
    documents.select(*keys, F.col("document").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).option("lineSep", "\n").text(path)


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def transcript_documents(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): one pretty JSON object {segments: [...]} per key."""
    whole = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("segments"))
    return whole.select(*keys, F.to_json(F.struct("segments"), {"pretty": "true"}).alias("document"))


def screen_event_documents(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): one pretty JSON list of a recording's screen events, in order of time."""
    fields = [c for c in events.columns if c not in keys]
    whole = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("timestamp", "event_id", *(c for c in fields if c not in ("timestamp", "event_id"))))).alias("events"))
    return whole.select(*keys, F.to_json("events", {"pretty": "true"}).alias("document"))


def timeline_documents(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): one pretty JSON list of a timeline's events."""
    whole = timeline.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("timestamp", "rank", "seq", "id", "duration", "type", "source", "text", "confidence"))).alias("events"))
    return whole.select(*keys, F.to_json(F.transform("events", lambda e: F.struct(*(e[c].alias(c) for c in ("id", "timestamp", "duration", "type", "source", "text", "confidence")))), {"pretty": "true"}).alias("document"))


def write_metadata(records: DataFrame, path: str) -> None:
    """A metadata file per recording; those of other recordings stay."""
    records.withColumn("key", F.col("video")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("key").json(path)


def write_index(lines: DataFrame, path: str, title: str) -> None:
    """A playlist's table of (line, playlist_index, video_id) as one Markdown file: one line per recording, in its order."""
    head = lines.sparkSession.createDataFrame([(0, 0, "", f"# {title}"), (0, 1, "", ""), (0, 2, "", "| # | Title | Status | Language | Transcript |"), (0, 3, "", "| --- | --- | --- | --- | --- |")], "part int, playlist_index int, video_id string, line string")
    rows = lines.select(F.lit(1).alias("part"), F.col("playlist_index").cast("int").alias("playlist_index"), "video_id", "line")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("part", "playlist_index", "video_id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def report_documents(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): a recording's report in Markdown, how much of what its timeline holds and between which times."""
    per = timeline.groupBy(*keys, "type").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    line = F.concat(F.lit("| "), "type", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), format_time("a"), F.lit(" | "), format_time("b"), F.lit(" |"))
    table = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("type", line.alias("line")))).alias("lines"), F.sum("n").alias("n"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return table.select(*keys, F.concat(F.lit("# "), F.col(keys[0]).cast("string"), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" events\n\n| type | events | first | last |\n| --- | --- | --- | --- |\n"), body, F.lit("\n")).alias("document"))


def master_report(timeline: DataFrame) -> DataFrame:
    """(document): one line per recording of all that were run."""
    per = timeline.groupBy("video").agg(F.count("*").alias("n"), F.max("timestamp").alias("b"))
    line = F.concat(F.lit("| "), "video", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), format_time("b"), F.lit(" |"))
    return per.select("video", line.alias("line"))


def write_reports(timeline: DataFrame, path: str) -> None:
    """A report per recording, and the lines of the report over all of them, which are replaced per recording too."""
    write_documents(report_documents(timeline, ["video"]), f"{path}/videos", ["video"])
    write_documents(master_report(timeline).withColumnRenamed("line", "document"), f"{path}/master", ["video"])


def render(formats: tuple[str, ...], segments: DataFrame, timeline: DataFrame, path: str) -> list[str]:
    """Write each format that is asked for, Markdown always, in parts of an hour per video. Returns the folders written."""
    keys = ["video", "part"]
    segments, timeline = captions.with_parts(segments, "start"), captions.with_parts(timeline, "timestamp")
    made = {"md": captions.render_markdown(segments, keys, F.col("video"))}
    if "json" in formats:
        made["json"] = transcript_documents(segments, keys)
        made["timeline"] = timeline_documents(timeline, keys)
    if "html" in formats:
        made["html"] = captions.render_html(timeline, keys)
    if "srt" in formats:
        made["srt"] = captions.render_srt(segments, keys)
        made["vtt"] = captions.render_vtt(segments, keys)
    for name, documents in made.items():
        write_documents(documents, f"{path}/{name}", keys)
    return [f"{path}/{name}" for name in made]

"""Substring search over a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import format_time, snippet


def search(timeline: DataFrame, query: str, types: list[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """(video, timestamp, type, source, text, context, confidence, seq) of the events whose text holds the query.

    The type filter comes first, so that it reaches the scan of a stored timeline; a null text is empty; an empty query
    matches everything. The result is unordered: ordered() sorts it.
    """
    rows = timeline.filter(F.col("type").isin(*types)) if types else timeline
    text = F.coalesce("text", F.lit(""))
    match = F.contains(text, F.lit(query)) if case_sensitive else F.contains(F.lower(text), F.lit(query.lower()))
    return rows.filter(match).select("video", "timestamp", "type", "source", F.substring(text, 1, 200).alias("text"), snippet(text, query, case_sensitive).alias("context"), "confidence", "seq")


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy("video", "timestamp", "seq")


def with_fallback(timeline: DataFrame, segments: DataFrame, observations: DataFrame, query: str, types: list[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """Search each video's timeline, or, where it has none, its transcript and screen text.

    The type filter holds for the fallback too.
    """
    from .fusion import screen_events, speech_events

    have = timeline.select("video").distinct()
    rest = speech_events(segments).unionByName(screen_events(observations)).join(have, "video", "left_anti")
    return search(timeline.unionByName(rest.select(*timeline.columns)), query, types, case_sensitive)


def result_line() -> Column:
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) != 0, F.format_string(" conf=%.3f", "confidence")).otherwise("")
    return F.concat(F.lit("  ["), format_time("timestamp"), F.lit("] "), F.rpad(F.upper("type"), 8, " "), F.lit(" | "), F.substring("text", 1, 120), confidence)


def report_lines(results: DataFrame) -> DataFrame:
    """(video, seq, header, line): each result as a line, and the video's heading where it begins."""
    place = F.struct("timestamp", "seq")
    first = results.groupBy("video").agg(F.min(place).alias("first"))
    heading = F.when(place == F.col("first"), F.concat(F.lit("── "), "video", F.lit(" ──")))
    return results.join(first, "video").select("video", "timestamp", "seq", heading.alias("header"), result_line().alias("line"))

"""The fused timeline: converters, union, event ids, speech context by interval-range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import format_time

TIMELINE = ("video", "timestamp", "duration", "type", "source", "text", "confidence", "rank", "seq")


def segments_of(transcript_segment: DataFrame) -> DataFrame:
    """(video, seq, start, end, text), repeated rows once; a segment without a start isn't on the timeline."""
    return transcript_segment.filter("start_s IS NOT NULL").select(F.col("video_id").alias("video"), F.col("segment_id").alias("seq"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text").distinct()


def observations_of(ocr_event: DataFrame) -> DataFrame:
    """(video, seq, timestamp, text, is_code, confidence), repeated rows once; an event without a time isn't on the timeline."""
    return ocr_event.filter("timestamp_s IS NOT NULL").select(F.col("video_id").alias("video"), F.col("event_id").alias("seq"), F.col("timestamp_s").alias("timestamp"), "text", F.coalesce("code_likelihood", F.lit(False)).alias("is_code"), F.col("mean_confidence").alias("confidence")).distinct()


def speech_events(segments: DataFrame) -> DataFrame:
    return segments.select("video", F.col("start").alias("timestamp"), (F.col("end") - F.col("start")).alias("duration"), F.lit("speech").alias("type"), F.lit("whisper").alias("source"), "text", F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("rank"), "seq")


def screen_events(observations: DataFrame) -> DataFrame:
    kind = F.when(F.col("is_code"), "code").otherwise("ocr")
    return observations.select("video", "timestamp", F.lit(None).cast("double").alias("duration"), kind.alias("type"), F.lit("paddleocr").alias("source"), "text", "confidence", F.lit(1).alias("rank"), "seq")


def scene_events(scenes: DataFrame) -> DataFrame:
    """From (video, seq, timestamp, difference)."""
    return scenes.select("video", "timestamp", F.lit(None).cast("double").alias("duration"), F.lit("scene").alias("type"), F.lit("sampler").alias("source"), F.lit(None).cast("string").alias("text"), F.col("difference").alias("confidence"), F.lit(2).alias("rank"), "seq")


def event_details(segments: DataFrame, observations: DataFrame) -> DataFrame:
    """(video, type, seq, metadata): what the converters note beside the timeline's columns, the number of recognised words of speech
    (of an array ``words``) and of lines of screen text (of an array ``lines``)."""
    word_count = F.create_map(F.lit("word_count"), F.coalesce(F.when(F.col("words").isNotNull(), F.size("words")), F.lit(0)).cast("string"))
    line_count = F.create_map(F.lit("line_count"), F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("string"))
    kind = F.when(F.col("is_code"), "code").otherwise("ocr")
    return segments.select("video", F.lit("speech").alias("type"), "seq", word_count.alias("metadata")).unionByName(observations.select("video", kind.alias("type"), "seq", line_count.alias("metadata")))


def fuse(*parts: DataFrame) -> DataFrame:
    """UNION ALL of converted streams; order_timeline gives ties their fixed order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_timeline(timeline: DataFrame) -> DataFrame:
    """By time; speech before screen, then input order."""
    return timeline.orderBy("video", "timestamp", "rank", "seq")


def event_id() -> Column:
    """A stable id of 12 hex digits from what identifies an event."""
    return F.substring(F.sha2(F.concat_ws("|", "video", "type", "source", F.col("seq").cast("string")), 256), 1, 12)


def context_pieces() -> Column:
    return F.concat(F.lit("["), format_time("start"), F.lit(" → "), format_time(F.coalesce("end", "start")), F.lit("] "), F.coalesce("text", F.lit("")))


def speech_context(observations: DataFrame, segments: DataFrame, radius: float = 10.0, range_s: float = 120.0, wide_s: float = 7200.0) -> DataFrame:
    """(video, seq, context): all speech whose interval touches [t - radius, t + radius], in transcript order, else ''.

    Time is cut into ranges of ``range_s``: an observation joins on (video, range) and a segment on each range it can touch, so
    a long or busy video is spread over many equal keys and no key compares all of a video with all. Observations are in one
    range each, so no pair comes twice. Segments longer than ``wide_s`` (an absurd end) join the ranges in which their video has
    observations instead of being spread over all of them.
    """
    obs = observations.select("video", "seq", F.col("timestamp").alias("t"), F.floor(F.col("timestamp") / range_s).alias("slot"))
    seg = segments.select("video", F.struct("seq", context_pieces().alias("piece")).alias("item"), F.col("start").alias("s"), F.greatest(F.coalesce("end", "start"), "start").alias("e"))
    seg = seg.withColumns({"first": F.floor((F.col("s") - radius) / range_s), "last": F.floor((F.col("e") + radius) / range_s)})
    is_wide = F.col("e") - F.col("s") > wide_s
    narrow = seg.filter(~is_wide).withColumn("slot", F.explode(F.sequence("first", "last")))
    wide = seg.filter(is_wide).join(obs.select("video", "slot").distinct(), "video").filter("slot BETWEEN first AND last")
    seg = narrow.unionByName(wide)
    o, s = obs.alias("o"), seg.select("video", "slot", "item", "s", "e").alias("s")
    near = (F.col("e") >= F.col("t") - radius) & (F.col("s.s") <= F.col("t") + radius)
    joined = o.join(s, (F.col("o.video") == F.col("s.video")) & (F.col("o.slot") == F.col("s.slot")) & near, "left")
    items = joined.groupBy("o.video", "o.seq").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return items.select("video", "seq", F.array_join(F.transform("items", lambda x: x["piece"]), " ").alias("context"))

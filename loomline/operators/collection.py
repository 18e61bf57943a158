"""A playlist's transcripts end to end: which recordings are left, captions or speech, quality, documents, metadata, index, summary.

Everything is a DataFrame over all recordings: entries (id, title, url, playlist_index), infos (a row per caption track), segments of
captions (video, kind, track, seq, start, end, text) and of speech (video, seq, start, end, text, quality). Fetching and recognising
are sources' tasks; a recording without any segments has failed and the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import caption_language_key, now_iso, slugify

from . import captions, quality, state

VERSION = "1"
#: What must be equal for a passed transcript to be kept.
SETTINGS = ("pipeline_version", "requested_language", "requested_model", "captions")


@dataclass(frozen=True)
class Request:
    language: str = "auto"
    model: str = "medium"
    captions: str = "prefer"
    force: bool = False

    def __post_init__(self) -> None:
        if self.captions not in ("prefer", "off"):
            raise ValueError("captions must be 'prefer' or 'off'")

    def settings(self) -> list[Column]:
        return [F.lit(v).alias(k) for k, v in zip(SETTINGS, (VERSION, self.language, self.model, self.captions))]


def left_over(entries: DataFrame, done: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """(to do, skipped) of the entries: with equal settings and a passed transcript in ``done`` (video, status and SETTINGS) there is
    nothing to do, unless forced."""
    wanted = entries.select("*", *request.settings())
    skipped = state.passed_before(wanted, done, ["video", *SETTINGS])
    if request.force:
        skipped = skipped.limit(0)
    return wanted.join(skipped.select("video"), "video", "left_anti"), skipped


def chosen_captions(infos: DataFrame, caption_segments: DataFrame, request: Request) -> DataFrame:
    """The segments (video, kind, track, seq, start, end, text) of the caption track to use of each recording."""
    tracks = infos.filter("track IS NOT NULL").select(F.col("video").alias("key"), "kind", "track", F.coalesce("original_language", "language").alias("declared"))
    if request.captions == "off":
        tracks = tracks.limit(0)
    code = captions.resolve_language(F.lit(request.language))
    track = captions.choose_track(tracks, code).withColumnRenamed("key", "video")
    return caption_segments.join(track, ["video", "kind", "track"], "left_semi")


def judged(segments: DataFrame, facts: DataFrame) -> DataFrame:
    """(video, kind, status, score, flags) of the segments of each recording and kind; facts are (video, language_probability, duration)."""
    keyed = segments.withColumn("key", F.struct("video", "kind"))
    keys = segments.select(F.struct("video", "kind").alias("key"), "video").distinct()
    known = keys.join(facts, "video", "left").select("key", F.when(F.col("key.kind") == "asr", F.col("language_probability")).alias("language_probability"), "duration")
    return quality.report(keyed.select("key", "seq", "text", "quality"), "key", known).select("key.video", "key.kind", "status", "score", "flags")


def transcribed(todo: DataFrame, infos: DataFrame, caption_segments: DataFrame, speech: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """(records, segments): a record per entry to do, with the source chosen and its quality, and the chosen segments.

    speech may have a column language, the recogniser's.
    """
    quality_type = dict(speech.dtypes)["quality"]
    spoken = speech if "language" in speech.columns else speech.withColumn("language", F.lit(None).cast("string"))
    if "language_probability" not in spoken.columns:
        spoken = spoken.withColumn("language_probability", F.lit(None).cast("double"))
    columns = ("video", "kind", "seq", "start", "end", "text", "quality", "language")
    by_caption = chosen_captions(infos, caption_segments, request).withColumns({"quality": F.lit(None).cast(quality_type), "language": caption_language_key("track")})
    every = by_caption.select(*columns).unionByName(spoken.withColumn("kind", F.lit("asr")).select(*columns))
    every = every.join(todo.select("video"), "video", "left_semi")
    facts = infos.groupBy("video").agg(F.max("duration").alias("duration")).join(spoken.groupBy("video").agg(F.max("language_probability").alias("language_probability")), "video", "full")
    sums = judged(every, facts)
    picked = quality.choose_source(sums.select(F.col("video").alias("key"), "kind", "status", "score")).withColumnRenamed("key", "video")
    # an automatic caption that passed is marked where the choice sent it to review
    flags = sums.select("video", "kind", "flags", F.col("status").alias("own_status"))
    picked = picked.join(flags, ["video", "kind"])
    sent = (F.col("own_status") == "passed") & (F.col("status") == "review_required")
    picked = picked.withColumn("flags", F.when(sent, F.concat("flags", F.array(F.lit("automatic_captions_not_human_verified")))).otherwise(F.col("flags"))).drop("own_status")
    segments = every.join(picked.select("video", "kind"), ["video", "kind"], "left_semi")
    spoken_in = segments.groupBy("video").agg(F.max("language").alias("detected_language"))
    titles = infos.groupBy("video").agg(F.first("title", ignorenulls=True).alias("info_title"), F.max("duration").alias("audio_duration"))
    records = todo.join(titles, "video", "left").join(picked, "video", "left").join(spoken_in, "video", "left")
    status = F.coalesce("status", F.lit("failed"))
    source = F.when(F.col("kind") == "asr", "speech").when(F.col("kind").isNotNull(), F.concat(F.lit("caption_"), "kind"))
    name = F.coalesce("detected_language", F.lit("und"))
    return records.select(
        "video", F.coalesce("info_title", "title").alias("title"), "url", "playlist_index", *SETTINGS, status.alias("status"), F.coalesce("score", F.lit(0)).alias("score"), "flags", source.alias("transcription_source"),
        F.when(F.col("kind") == "asr", F.col("requested_model")).alias("model"), "detected_language", captions.language_name(F.col("detected_language")).alias("detected_language_name"), "audio_duration",
        F.when(F.col("kind").isNotNull(), F.concat(F.lit("transcript."), name, F.lit(".md"))).alias("transcript_file"), now_iso().alias("generated_at"),
    ), segments


def folder_name(record_index: Column, title: Column, video: Column) -> Column:
    return F.concat_ws("_", F.lpad(record_index.cast("string"), 3, "0"), slugify(title, 55), slugify(video, 20))


def summary(records: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: the counts of the run with its exit code, those skipped too."""
    return quality.run_summary(records.select("status").unionByName(skipped.select(F.lit("skipped").alias("status"))))

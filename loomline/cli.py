"""Command line: each command runs only its own stage.

    python -m loomline.cli run FOLDER OUT [--preset coding] [--formats md,srt]
    python -m loomline.cli transcribe|ocr|export FOLDER OUT
    python -m loomline.cli captions FOLDER OUT
    python -m loomline.cli youtube-transcribe FOLDER OUT [--language auto] [--captions prefer|off] [--playlist-start 1]
    python -m loomline.cli search FOLDER QUERY [--type code,ocr] [--case-sensitive]
    python -m loomline.cli status OUT

FOLDER holds one folder per recording with transcript.json and ocr_events.json (or timeline.json for search). For
youtube-transcribe it holds playlist.json, and per recording info.json, captions as KIND.TRACK.vtt (manual.hi.vtt) and what was recognised
of its speech as transcript.json: fetching and recognising are done before.

A stage that is complete for a recording isn't run again, unless its files have changed or --force is given.
"""

from __future__ import annotations

import argparse
import glob
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.config import Config, load_config, preset, with_values
from loomline.functions.text import now_iso, slugify_name, watch_url
from loomline.operators import captions, collection, fusion, quality, search, sequence, state
from loomline.session import build_session, materialize
from loomline.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "transcribe", "ocr", "export", "captions"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("out")
        c.add_argument("--preset", default="default")
        c.add_argument("--config")
        c.add_argument("--formats")
        c.add_argument("--force", action="store_true")
        for flag in ("similarity", "heartbeat", "radius"):
            c.add_argument(f"--{flag}", type=float)
    c = sub.add_parser("youtube-transcribe")
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--language", default="auto")
    c.add_argument("--whisper-model", default="medium")
    c.add_argument("--captions", choices=("prefer", "off"), default="prefer")
    c.add_argument("--playlist-start", type=int, default=1)
    c.add_argument("--playlist-end", type=int)
    c.add_argument("--max-videos", type=int)
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("folder")
    c.add_argument("query")
    c.add_argument("--type")
    c.add_argument("--case-sensitive", action="store_true")
    c = sub.add_parser("status")
    c.add_argument("out")
    return p


def configured(args: argparse.Namespace) -> Config:
    """A file beats the preset; flags beat both."""
    base = load_config(args.config) if args.config else preset(args.preset)
    flags = {"ocr_change_similarity": args.similarity, "ocr_heartbeat": args.heartbeat, "context_radius": args.radius, "output_formats": args.formats.split(",") if args.formats else None}
    return with_values(base, flags)


def _found(folder: str, name: str) -> list[str]:
    return sorted(glob.glob(f"{folder}/*/{name}"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    paths = _found(folder, "transcript.json")
    if not paths:
        return spark.createDataFrame([], f"video string, seq bigint, start double, end double, text string, quality {readers.QUALITY}")
    return readers.read_transcripts(spark, paths).drop("words")


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    paths = _found(folder, "ocr_events.json")
    if not paths:
        return spark.createDataFrame([], "video string, seq bigint, timestamp double, text string, is_code boolean, confidence double")
    rows = readers.read_screen_events(spark, paths)
    return rows.select("video", F.col("event_id").alias("seq"), "timestamp", "text", F.coalesce("code_likelihood", F.lit(False)).alias("is_code"), F.col("mean_confidence").alias("confidence"))


def _videos(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(video), and (video, size_bytes, modified_at, head_hash) of the files that a recording's results come from, as one identity."""
    paths = [p for name in ("transcript.json", "ocr_events.json") for p in _found(folder, name)]
    if not paths:
        empty = spark.createDataFrame([], "video string, size_bytes bigint, modified_at string, head_hash string")
        return empty.select("video"), empty
    files = state.identities(spark.read.format("binaryFile").load(paths)).withColumn("video", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    one = files.groupBy("video").agg(F.sum("size_bytes").alias("size_bytes"), F.max("modified_at").alias("modified_at"), F.sha2(F.array_join(F.sort_array(F.collect_list("head_hash")), ""), 256).alias("head_hash"))
    return one.select("video"), one


class Stages:
    """What is done of each recording under ``out``, and running what isn't."""

    def __init__(self, spark: SparkSession, folder: str, out: str, force: bool) -> None:
        self.spark, self.out, self.force = spark, out, force
        self.videos, now = (materialize(x) for x in _videos(spark, folder))
        kept = f"{out}/identity"
        try:
            stored = materialize(spark.read.schema(now.schema).parquet(kept))
        except AnalysisException:
            stored = spark.createDataFrame([], now.schema)
        changed = state.changed(now, stored)
        known = readers.read_states(spark, f"{out}/state")
        self.recorded = materialize(known.join(changed, "video", "left_anti"))
        rest = stored.join(now.select("video"), "video", "left_anti")
        materialize(now.unionByName(rest)).write.mode("overwrite").parquet(kept)

    def run(self, stage: str, work) -> None:
        """``work(todo)`` for the recordings whose stage isn't complete; the stage is running meanwhile, and partial if it fails."""
        todo = materialize(state.left_to_do(self.videos, self.recorded, stage, self.force))
        if todo.isEmpty():
            return
        self.mark(todo, stage, "running")
        try:
            work(todo)
        except Exception:
            self.mark(todo, stage, "partial")
            raise
        self.mark(todo, stage, "complete")

    def mark(self, videos: DataFrame, stage: str, status: str) -> None:
        mine = videos.select("video", F.lit(stage).alias("stage"), F.lit(status).alias("status"))
        others = self.recorded.join(mine.select("video", "stage"), ["video", "stage"], "left_anti")
        self.recorded = materialize(others.unionByName(mine))
        state.save(self.recorded.join(videos, "video", "left_semi"), f"{self.out}/state")


def _write(rows: DataFrame, path: str) -> None:
    """Replace the parts of the recordings in ``rows`` only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(path)


def _transcribe_collection(spark: SparkSession, args: argparse.Namespace) -> int:
    request = collection.Request(args.language, args.whisper_model, args.captions, args.force)
    listed = readers.read_playlist(spark, f"{args.folder}/playlist.json")
    entries = captions.checked_entries(listed, start=args.playlist_start, end=args.playlist_end, most=args.max_videos)
    entries = materialize(entries.select(F.col("id").alias("video"), "title", watch_url("url", "id").alias("url"), F.col("original_index").alias("playlist_index"), "playlist_id", "playlist_title"))
    title = slugify_name(entries.first()["playlist_title"])
    out = f"{args.out}/{title}"
    schema = f"video string, status string, {', '.join(f'{k} string' for k in collection.SETTINGS)}"
    try:
        done = materialize(spark.read.schema(schema).json(f"{out}/metadata"))
    except AnalysisException:
        done = spark.createDataFrame([], schema)
    infos = readers.read_video_infos(spark, _found(args.folder, "info.json")) if _found(args.folder, "info.json") else spark.createDataFrame([], "video string, title string, duration double, language string, original_language string, kind string, track string")
    files = _found(args.folder, "*.vtt")
    spoken = "video string, kind string, track string, seq bigint, start double, end double, text string"
    cues = spark.createDataFrame([], spoken)
    if files:
        parts = F.regexp_extract
        path = r"([^/]+)/([^/.]+)\.([^/]+)\.vtt$"
        cues = readers.read_vtt(spark, files).select(*(parts("doc", path, i + 1).alias(c) for i, c in enumerate(("video", "kind", "track"))), F.col("index").cast("long").alias("seq"), "start", "end", "text")
    todo, skipped = (materialize(x) for x in collection.left_over(entries, done, request))
    records, segments = (materialize(x) for x in collection.transcribed(todo, infos, cues, _segments(spark, args.folder), request))
    heading = F.coalesce("title", F.col("video"))
    named = segments.join(records.select("video", "title"), "video")
    for name, documents in (("md", captions.render_markdown(named.withColumn("heading", heading), ["video", "heading"], F.col("heading"))), ("srt", captions.render_srt(segments, "video")), ("vtt", captions.render_vtt(segments, "video")), ("json", writers.transcript_documents(segments, ["video"]))):
        writers.write_documents(documents, f"{out}/transcripts/{name}", ["video"])
    writers.write_metadata(records, f"{out}/metadata")
    link = F.when(F.col("transcript_file").isNotNull(), F.concat(F.lit("transcripts/md/video="), "video"))
    old = skipped.select("video", "title", "playlist_index", F.lit("skipped (already passed quality checks)").alias("status"), F.lit(None).cast("string").alias("language_name"), F.concat(F.lit("transcripts/md/video="), "video").alias("transcript_link"))
    new = records.select("video", "title", "playlist_index", F.when(F.col("status") == "passed", "completed").otherwise(F.col("status")).alias("status"), F.col("detected_language_name").alias("language_name"), link.alias("transcript_link"))
    index = old.unionByName(new).withColumns({"playlist_id": F.lit(title), "video_id": F.col("video")})
    writers.write_index(captions.playlist_index_lines(index).join(index.select("video_id", "playlist_index"), "video_id"), f"{out}/playlist_index", title)
    summary = collection.summary(records, skipped)
    writers.write_json_lines(summary.withColumn("updated_at", now_iso()), f"{out}/run_summary")
    return summary.first()["exit_code"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or build_session()
    if args.command == "status":
        recorded = readers.read_states(spark, f"{args.out}/state")
        for r in state.stage_report(recorded.select("video"), recorded).orderBy("video").toLocalIterator():
            print(r["video"], r["report"])
        return 0
    if args.command == "search":
        files = _found(args.folder, "timeline.json")
        shape = "video string, timestamp double, duration double, type string, source string, text string, confidence double, rank int, seq bigint"
        stored = readers.read_timelines(spark, files) if files else spark.createDataFrame([], f"video string, {readers.TIMELINE}")
        known = stored.withColumns({"rank": F.lit(0), "seq": F.monotonically_increasing_id()}).select(*[x.split()[0] for x in shape.split(", ")])
        found = search.with_fallback(known, _segments(spark, args.folder), _observations(spark, args.folder), args.query, args.type.split(",") if args.type else None, args.case_sensitive)
        n = 0
        for r in search.report_lines(found).orderBy("video", "timestamp", "seq").toLocalIterator():
            n += 1
            if r["header"]:
                print(r["header"])
            print(r["line"])
        if not n:
            print(f'No results found for: "{args.query}"')
        return 0
    if args.command == "youtube-transcribe":
        return _transcribe_collection(spark, args)
    config = configured(args)
    if args.command == "captions":
        readers.read_vtt(spark, _found(args.folder, "*.vtt")).write.mode("overwrite").json(f"{args.out}/captions")
        return 0
    segments, observations = _segments(spark, args.folder), _observations(spark, args.folder)
    stages = Stages(spark, args.folder, args.out, args.force)
    of = lambda rows, todo: rows.join(todo, "video", "left_semi")

    def transcribe(todo: DataFrame) -> None:
        _write(quality.report(of(segments, todo), "video"), f"{args.out}/quality")

    def screen(todo: DataFrame) -> None:
        seen = of(observations, todo)
        chosen = sequence.keep_changed(seen, config.ocr_change_similarity, config.ocr_heartbeat, config.min_ocr_chars).select("video", "seq")
        kept = seen.join(chosen, ["video", "seq"], "left_semi")
        _write(kept.join(fusion.speech_context(kept, of(segments, todo), config.context_radius, 12 * config.context_radius), ["video", "seq"]), f"{args.out}/screen")

    def fused(todo: DataFrame) -> DataFrame:
        """Of the screen events that were kept, or all of a recording whose screen stage hasn't run."""
        try:
            kept = spark.read.parquet(f"{args.out}/screen").withColumn("video", F.col("video").cast("string")).select(*observations.columns)
        except AnalysisException:
            kept = observations.limit(0)
        ran = stages.recorded.filter("stage = 'ocr' AND status = 'complete'").select("video")
        chosen = kept.join(ran, "video", "left_semi").unionByName(observations.join(ran, "video", "left_anti"))
        return fusion.fuse(fusion.speech_events(of(segments, todo)), fusion.screen_events(of(chosen, todo))).withColumn("id", fusion.event_id())

    def fuse(todo: DataFrame) -> None:
        _write(fused(todo).repartition("video").sortWithinPartitions("video", "timestamp", "rank", "seq"), f"{args.out}/timeline")

    def render(todo: DataFrame) -> None:
        timeline = fused(todo)
        writers.render(config.output_formats, of(segments, todo), timeline, f"{args.out}/documents")
        writers.write_reports(timeline, f"{args.out}/reports")

    if args.command in ("run", "transcribe"):
        stages.run("transcription", transcribe)
    if args.command in ("run", "ocr"):
        stages.run("ocr", screen)
    if args.command in ("run", "export"):
        stages.run("fusion", fuse)
        stages.run("output", render)
    if args.command in ("run", "transcribe"):
        try:
            judged = spark.read.parquet(f"{args.out}/quality").select("status")
        except AnalysisException:
            return 1  # nothing was found
        return quality.run_summary(judged).first()["exit_code"]
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Readers: explicit schemas, tolerant of missing fields; a file that can't be parsed gives no rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loomline.functions.fixed import VIDEO_SUFFIXES
from loomline.functions.text import clean_text
from loomline.operators import boxes as boxes_of
from loomline.operators import captions

QUALITY = "struct<avg_logprob: double, no_speech_prob: double, compression_ratio: double, temperature: double, seek: bigint>"
BOX = "struct<text: string, confidence: double, x1: int, y1: int, x2: int, y2: int>"
SEGMENT = f"struct<index: int, start: double, end: double, text: string, words: array<struct<start: double, end: double, word: string, probability: double>>, quality: {QUALITY}>"
TRANSCRIPT = f"segments array<{SEGMENT}>, meta struct<model: string, language: string, duration: double, audio_duration: double>"
SCREEN = f"event_id bigint, timestamp double, frame_index bigint, text string, lines array<string>, boxes array<{BOX}>, mean_confidence double, code_likelihood boolean, preprocessing string, evidence_frame string, speech_context string"
TIMELINE = "id string, timestamp double, duration double, type string, source string, text string, confidence double, frame_path string, metadata map<string, string>"


def _video(column: str = "_metadata.file_path") -> Column:
    """The name of the folder a file lies in; of a partition's folder (key=value), the value."""
    return F.regexp_extract(column, r"(?:[^/=]+=)?([^/=]+)/[^/]+$", 1)


def find_videos(spark: SparkSession, folder: str, output_name: str | None = None) -> DataFrame:
    """(path, length, modificationTime, content) of the recordings under a folder, by suffix in any case, in path order; what
    lies in a folder of the output's name is left out. Only columns that are asked for are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*VIDEO_SUFFIXES))
    if output_name:
        files = files.filter(~F.array_contains(F.split("path", "/"), output_name))
    return files.orderBy("path")


def _json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(paths)


def read_transcripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(video, seq, start, end, text, words, quality) of transcript.json files: texts cleaned, empty ones dropped, order dense from 0."""
    rows = _json(spark, paths, TRANSCRIPT).select(_video().alias("video"), F.posexplode("segments").alias("pos", "s")).select("video", "pos", "s.*")
    rows = rows.withColumn("text", clean_text("text")).filter("text IS NOT NULL AND text != ''")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("video").orderBy("pos")) - 1).select("video", F.col("seq").cast("long"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", "start", F.lit(0.0)).alias("end"), "text", "words", "quality")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(video, stage, status) of the recorded stages; a table that is missing or can't be read has no rows."""
    schema = "video string, stage string, status string"
    try:
        found = spark.read.parquet(path)
        return found.select(*(F.col(c).cast("string").alias(c) for c in ("video", "stage", "status")))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_video_infos(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(video, id, title, url, duration, language, original_language, kind, track) of info.json files: a row per caption track, and one
    with a null track where a recording has none."""
    listed = "map<string, array<struct<ext: string, url: string>>>"
    schema = f"id string, title string, webpage_url string, duration double, language string, original_language string, subtitles {listed}, automatic_captions {listed}"
    rows = _json(spark, paths, schema).select(_video().alias("video"), "*")
    of = lambda column, kind: F.transform(F.map_keys(F.coalesce(column, F.expr(f"cast(map() as {listed})"))), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("track")))
    tracks = F.concat(of(F.col("subtitles"), "manual"), of(F.col("automatic_captions"), "automatic"))
    return rows.select("video", "id", "title", F.col("webpage_url").alias("url"), "duration", "language", "original_language", F.explode_outer(tracks).alias("t")).select("video", "id", "title", "url", "duration", "language", "original_language", "t.kind", "t.track")


def read_screen_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _json(spark, paths, SCREEN).select(_video().alias("video"), "*")


def read_timelines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _json(spark, paths, TIMELINE).select(_video().alias("video"), "*")


def read_vtt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("raw"))
    return captions.parse_vtt(files)


def read_playlist(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(playlist_id, playlist_title, position, id, title, url, playlist_index) of the entries that aren't null."""
    schema = "id string, title string, entries array<struct<id: string, title: string, url: string, webpage_url: string, playlist_index: int>>"
    rows = _json(spark, paths, schema).select(F.col("id").alias("playlist_id"), F.col("title").alias("playlist_title"), F.posexplode("entries").alias("pos", "e")).filter("e IS NOT NULL")
    return rows.select("playlist_id", "playlist_title", (F.col("pos") + 1).alias("position"), "e.id", "e.title", F.coalesce("e.webpage_url", "e.url").alias("url"), "e.playlist_index")


def recognize_boxes(images: DataFrame, model: Callable[[bytes], dict], fallback: Callable[[bytes], dict] | None = None) -> DataFrame:
    """(path, boxes, text, mean_confidence, error) of (path, content): a screen-text model applied to each picture.

    The model gives rec_texts, rec_scores and rec_boxes or rec_polys (of two- or four-number points), alone or under ``res``; what is
    missing has its default. The lists become boxes in reading order.
    """
    schema = "path string, payload string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found, error = first_that_works((model, fallback), content)
                rows.append((path, None if error else json.dumps(found), error))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "payload", "error"])

    lists = "struct<rec_texts: array<string>, rec_scores: array<double>, rec_boxes: array<array<double>>, rec_polys: array<array<array<double>>>>"
    raw = images.select("path", "content").mapInArrow(run, schema).withColumn("r", boxes_of.unwrapped_result(F.col("payload"), lists))
    sides = F.coalesce(F.transform("r.rec_boxes", lambda b: boxes_of.box_rectangle(F.array(b))), F.transform("r.rec_polys", boxes_of.box_rectangle))
    listed = raw.select("path", "error", boxes_of.recognized_boxes(F.col("r.rec_texts"), F.col("r.rec_scores"), sides).alias("boxes"))
    order = F.flatten(F.transform(boxes_of.in_lines(F.transform("boxes", lambda b, i: F.struct(i.alias("box_pos"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2")))), lambda line: F.array_sort(line["members"])))
    placed = listed.withColumn("boxes", F.when(F.col("error").isNull(), F.transform(order, lambda m: F.get("boxes", m["box_pos"]))))
    return placed.select("path", "boxes", boxes_of.joined_lines(F.col("boxes")).alias("text"), F.when(F.col("error").isNull(), boxes_of.mean_confidence(F.col("boxes"))).alias("mean_confidence"), "error")


def first_that_works(models: tuple, content: bytes) -> tuple:
    """(result, error) of the first of the models that doesn't fail; the error of the last if all do."""
    error = None
    for model in models:
        if model is not None:
            try:
                return model(content), None
            except Exception as problem:  # noqa: BLE001 - any failure of a foreign model is one file's failure
                error = f"{type(problem).__name__}: {problem}"
    return None, error


def serialized_words(words: Column) -> Column:
    """array<struct<start, end, word, probability>> of a recogniser's words, whatever types it gave: what isn't a number is null."""
    number = lambda w, k: w[k].try_cast("double").alias(k)
    return F.transform(words, lambda w: F.struct(number(w, "start"), number(w, "end"), F.coalesce(w["word"].cast("string"), F.lit("")).alias("word"), number(w, "probability")))


def recognize(media: DataFrame, model: Callable[[bytes], list[dict]], fallback: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """(path, index, start, end, text, words, quality, meta, error): a speech model applied to each file's content.

    The model gives dicts with start, end and text, and optionally words and quality, or (such dicts, a dict about the whole file); they
    are read to the end inside the attempt. If it fails, the fallback is tried once; if that fails too, the file gives one row with the
    error, and the others go on. Texts are cleaned, empty ones dropped, the rest indexed from 0.
    """
    text = pa.string()
    word = pa.list_(pa.struct([("start", text), ("end", text), ("word", text), ("probability", text)]))
    numbers = ("avg_logprob", "no_speech_prob", "compression_ratio", "temperature")
    kind = pa.struct([*((k, pa.float64()) for k in numbers), ("seek", pa.int64())])
    schema = pa.schema([("path", text), ("index", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("text", text), ("words", word), ("quality", kind), ("meta", pa.map_(text, text)), ("error", text)])

    def read(attempt: Callable) -> Callable:
        def whole(content: bytes) -> tuple[list[dict], dict]:
            given = attempt(content)
            found, meta = given if isinstance(given, tuple) else (given, {})
            return list(found), dict(meta)

        return whole

    def word_of(w: dict) -> dict:
        return {k: None if w.get(k) is None else str(w[k]) for k in ("start", "end", "word", "probability")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                given, error = first_that_works(tuple(m and read(m) for m in (model, fallback)), content)
                if given is None:
                    rows.append({"path": path, "error": error})
                    continue
                found, meta = given
                about = [(k, str(v)) for k, v in meta.items() if v is not None]
                texts = [(x, " ".join((x.get("text") or "").split())) for x in found]
                rows += [
                    {"path": path, "index": i, "start": x.get("start"), "end": x.get("end"), "text": t, "words": [word_of(w) for w in x.get("words") or ()], "quality": x.get("quality"), "meta": about}
                    for i, (x, t) in enumerate((x, t) for x, t in texts if t)
                ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    out = f"path string, index int, start double, end double, text string, words array<struct<start: string, end: string, word: string, probability: string>>, quality {QUALITY}, meta map<string, string>, error string"
    return media.select("path", "content").mapInArrow(run, out).withColumn("words", serialized_words(F.col("words")))

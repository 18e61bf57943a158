"""Round trips: what the writers store in the shared folder is read back by the readers and compared with the tables it came from."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.fixed import SPACE
from loomline.operators import boxes, captions, fusion, state
from loomline.plans import timeline as timelines
from loomline.plans.text import _strip
from loomline.session import checkpoint_dir, table
from loomline.sources import readers, writers


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/exchange-{uuid.uuid4().hex}"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """One row per place of a transcript."""
    rows = table(spark, d, "transcript_segment").filter("transcript_id IS NOT NULL").dropDuplicates(["segment_id"])
    return rows.select(F.col("transcript_id").cast("string").alias("video"), F.col("seg_index").cast("long").alias("seq"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "quality")


def stored_transcripts(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    writers.write_documents(writers.transcript_documents(_segments(spark, d), ["video"]), folder, ["video"])
    return readers.read_transcripts(spark, folder).select("video", "seq", "start", "end", "text")


def stored_screen_events(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    events = table(spark, d, "ocr_event").filter("video_id IS NOT NULL").dropDuplicates(["event_id"]).select(F.col("video_id").alias("video"), "event_id", F.col("timestamp_s").alias("timestamp"), "frame_index", "text", "lines", "boxes", "mean_confidence", "code_likelihood")
    writers.write_documents(writers.screen_event_documents(events, ["video"]), folder, ["video"])
    return readers.read_screen_events(spark, folder).select("video", "event_id", "timestamp", "text", F.coalesce(F.size("boxes"), F.lit(-1)).alias("n_boxes"), "code_likelihood")


def stored_timeline(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    events = timelines.timeline(spark, d).filter("video IS NOT NULL").withColumn("id", fusion.event_id())
    writers.write_documents(writers.timeline_documents(events, ["video"]), folder, ["video"])
    return readers.read_timelines(spark, folder).select("video", "timestamp", "type", "source", "text", F.length("id").alias("id_length"))


def stored_states(spark: SparkSession, d: str) -> DataFrame:
    """Stages are saved per recording; saving some again replaces theirs alone."""
    folder = _folder(spark)
    rows = table(spark, d, "orders").select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string").substr(-1, 1)).alias("video"), F.lit("ocr").alias("stage"), F.lit("running").alias("status")).distinct()
    state.save(rows, folder)
    state.save(rows.filter("video < 'v5'").withColumn("status", F.lit("complete")), folder)
    return readers.read_states(spark, folder)


def stored_infos(spark: SparkSession, d: str) -> DataFrame:
    """Document languages as caption tracks in info files, a row per track."""
    folder = _folder(spark)
    docs = table(spark, d, "documents").filter("video_id IS NOT NULL AND lang IS NOT NULL AND source IN ('caption_manual', 'caption_automatic')").select(F.col("video_id").alias("video"), "lang", "source").distinct()
    tracks = lambda kind: F.map_from_entries(F.collect_set(F.when(F.col("source") == kind, F.struct("lang", F.array(F.struct(F.lit("vtt").alias("ext"), F.lit("u").alias("url"))).alias("formats")))))
    infos = docs.groupBy("video").agg(tracks("caption_manual").alias("subtitles"), tracks("caption_automatic").alias("automatic_captions"))
    files = infos.select("video", F.to_json(F.struct(F.col("video").alias("id"), F.lit(60.0).alias("duration"), "subtitles", "automatic_captions")).alias("document"))
    writers.write_documents(files, folder, ["video"])
    return readers.read_video_infos(spark, folder).select("video", "kind", "track", "duration")


def _playlists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "video_metadata").filter("playlist_id IS NOT NULL").select("playlist_id", "video_id", "title", "playlist_index", "url").dropDuplicates(["video_id"])


def stored_playlists(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    entry = F.struct(F.col("video_id").alias("id"), "title", F.col("url").alias("webpage_url"), "playlist_index")
    files = _playlists(spark, d).groupBy("playlist_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    writers.write_documents(files.select("playlist_id", F.to_json(F.struct(F.col("playlist_id").alias("id"), "entries")).alias("document")), folder, ["playlist_id"])
    return readers.read_playlist(spark, folder).select("playlist_id", "position", "id", "title", "url", "playlist_index")


def appended_lines(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are appended as they come, nulls kept as fields."""
    folder = _folder(spark)
    rows = table(spark, d, "region").select("r_regionkey", F.nullif("r_name", F.lit("ASIA")).alias("r_name"))
    for _ in range(2):
        writers.write_json_lines(rows, folder, append=True)
    back = spark.read.text(folder).select(F.from_json("value", "r_regionkey int, r_name string").alias("x"), F.contains("value", F.lit("r_name")).alias("has_name"))
    return back.groupBy("x.r_regionkey", "x.r_name", "has_name").agg(F.count("*").alias("n"))


def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A metadata file per recording; writing some again leaves the others."""
    folder = _folder(spark)
    rows = table(spark, d, "video_metadata").filter("video_id IS NOT NULL").select(F.col("video_id").alias("video"), "title", "detected_language", "audio_duration").dropDuplicates(["video"])
    writers.write_metadata(rows.withColumn("status", F.lit("running")), folder)
    writers.write_metadata(rows.filter("length(title) % 2 = 0").withColumn("status", F.lit("passed")), folder)
    return spark.read.schema("video string, title string, detected_language string, audio_duration double, status string").json(folder).drop("key")


def _first_texts(content: bytes) -> list[dict]:
    """The registered stand-in for a speech model: its 'audio' is the JSON of what was said."""
    return json.loads(content)


def speech_source(spark: SparkSession, d: str) -> DataFrame:
    """Stored segments as media of a model that reads them: cleaned, without empty ones, indexed from 0."""
    rows = _segments(spark, d).groupBy("video").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text")))).cast("binary").alias("content"))
    found = readers.recognize(rows.withColumnRenamed("video", "path"), _first_texts)
    return found.select("path", F.col("index").cast("long").alias("index"), "start", "end", "text")


def screen_source(spark: SparkSession, d: str) -> DataFrame:
    """Stored boxes as pictures of a model that gives parallel lists: scores of the first two only, rectangles of all."""
    rows = table(spark, d, "ocr_event").filter("boxes IS NOT NULL").select(F.col("event_id").cast("string").alias("path"), "boxes").dropDuplicates(["path"])
    lists = F.struct(
        F.transform("boxes", lambda b: F.coalesce(b["text"], F.lit(" "))).alias("rec_texts"), F.slice(F.transform("boxes", lambda b: F.coalesce(b["confidence"], F.lit(0.5))), 1, 2).alias("rec_scores"),
        F.transform("boxes", lambda b: F.array(*(F.coalesce(b[k], F.lit(0)).cast("double") for k in ("x1", "y1", "x2", "y2")))).alias("rec_boxes"),
    )
    payload = F.when(F.length("path") % 2 == 0, F.to_json(F.struct(lists.alias("res")))).otherwise(F.to_json(lists))
    found = readers.recognize_boxes(rows.select("path", payload.cast("binary").alias("content")), _first_texts)
    n = F.size("boxes")
    ones = F.size(F.filter("boxes", lambda b: b["confidence"] == 1.0))
    sides = F.aggregate("boxes", F.lit(0).cast("bigint"), lambda s, b: s + b["x1"] + b["y2"])
    return found.select("path", n.alias("n_boxes"), sides.alias("sides"), (ones >= F.greatest(n - 2, F.lit(0))).alias("defaults"))


def unwrapped_results(spark: SparkSession, d: str) -> DataFrame:
    """A result alone or under res."""
    rows = table(spark, d, "documents").select("doc_id", F.struct(F.col("source").alias("text"), F.col("n_chars").alias("n")).alias("r"))
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("r").alias("res")))).when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json("r"))
    out = boxes.unwrapped_result(payload, "struct<text: string, n: bigint>")
    return rows.select("doc_id", out.alias("x")).select("doc_id", "x.text", "x.n")


def reports(spark: SparkSession, d: str) -> DataFrame:
    return writers.report_documents(timelines.timeline(spark, d).filter("video IS NOT NULL"), ["video"])


def master_report(spark: SparkSession, d: str) -> DataFrame:
    return writers.master_report(timelines.timeline(spark, d).filter("video IS NOT NULL"))


def render_html(spark: SparkSession, d: str) -> DataFrame:
    return captions.render_html(captions.with_parts(timelines.timeline(spark, d).filter("video IS NOT NULL"), "timestamp"), ["video", "part"])


_ALL = (stored_transcripts, stored_screen_events, stored_timeline, stored_states, stored_infos, stored_playlists, appended_lines, stored_metadata, speech_source, screen_source, unwrapped_results, reports, master_report, render_html)
QUERIES = {f.__name__: f for f in _ALL}

_CLEAN = _strip("regexp_replace(replace(replace(text, chr(160), ' '), chr(13), ''), '[ \\t]+', ' ', 'g')")
_PLACES = "WITH s AS (SELECT segment_id, any_value(transcript_id) AS t, any_value(seg_index) AS i, any_value(start_s) AS a, any_value(end_s) AS b, any_value(text) AS text FROM transcript_segment WHERE transcript_id IS NOT NULL GROUP BY segment_id) "
_TIME = timelines.sql_time
_ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL = {
    "stored_transcripts": _PLACES.rstrip() + f""", c AS (SELECT t, i, a, b, segment_id, {_CLEAN} AS text FROM s)
 SELECT CAST(t AS VARCHAR) AS video, row_number() OVER (PARTITION BY t ORDER BY i, a NULLS FIRST, b NULLS FIRST) - 1 AS seq, coalesce(a, 0.0) AS "start", coalesce(b, a, 0.0) AS "end", text FROM c WHERE text <> ''""",
    "stored_screen_events": "SELECT DISTINCT video_id AS video, event_id, timestamp_s AS timestamp, text, coalesce(len(boxes), -1) AS n_boxes, code_likelihood FROM ocr_event WHERE video_id IS NOT NULL",
    "stored_timeline": timelines._WITH + "SELECT video, timestamp, type, source, text, 12 AS id_length FROM timeline WHERE video IS NOT NULL",
    "stored_states": "SELECT DISTINCT 'v' || right(CAST(o_orderkey AS VARCHAR), 1) AS video, 'ocr' AS stage, CASE WHEN right(CAST(o_orderkey AS VARCHAR), 1) < '5' THEN 'complete' ELSE 'running' END AS status FROM orders",
    "stored_infos": "SELECT DISTINCT video_id AS video, CASE source WHEN 'caption_manual' THEN 'manual' ELSE 'automatic' END AS kind, lang AS track, 60.0::DOUBLE AS duration FROM documents WHERE video_id IS NOT NULL AND lang IS NOT NULL AND source IN ('caption_manual', 'caption_automatic')",
    "stored_playlists": """WITH v AS (SELECT DISTINCT playlist_id, video_id, title, playlist_index, url FROM video_metadata WHERE playlist_id IS NOT NULL)
 SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY video_id) AS position, video_id AS id, title, url, playlist_index FROM v""",
    "appended_lines": "SELECT r_regionkey, nullif(r_name, 'ASIA') AS r_name, true AS has_name, 2 AS n FROM region",
    "stored_metadata": "SELECT DISTINCT video_id AS video, title, detected_language, audio_duration, CASE WHEN length(title) % 2 = 0 THEN 'passed' ELSE 'running' END AS status FROM video_metadata WHERE video_id IS NOT NULL",
    "speech_source": _PLACES.rstrip() + f""", c AS (SELECT t, i, a, b, {_strip(f"regexp_replace(text, '{SPACE}+', ' ', 'g')")} AS text FROM s)
 SELECT CAST(t AS VARCHAR) AS path, row_number() OVER (PARTITION BY t ORDER BY i, a NULLS FIRST, b NULLS FIRST) - 1 AS index, a AS "start", b AS "end", text FROM c WHERE text <> ''""",
    "screen_source": f"""WITH e AS (SELECT event_id, any_value(boxes) AS boxes FROM ocr_event WHERE boxes IS NOT NULL GROUP BY 1), k AS (SELECT event_id, list_filter(boxes, lambda b: {_strip("coalesce(b.text, '')")} <> '') AS boxes FROM e)
 SELECT CAST(event_id AS VARCHAR) AS path, len(boxes) AS n_boxes, CAST(coalesce(list_sum(list_transform(boxes, lambda b: coalesce(b.x1, 0) + coalesce(b.y2, 0))), 0) AS BIGINT) AS sides, true AS defaults FROM k""",
    "unwrapped_results": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 7 <> 0 THEN source END AS text, CASE WHEN doc_id % 2 = 0 OR doc_id % 7 <> 0 THEN n_chars END AS n FROM documents",
    "reports": timelines._WITH.rstrip() + f""", p AS (SELECT video, type, count(*) AS n, min(timestamp) AS a, max(timestamp) AS b FROM timeline WHERE video IS NOT NULL GROUP BY 1, 2)
 SELECT video, '# ' || video || chr(10) || chr(10) || CAST(sum(n) AS BIGINT) || ' events' || chr(10) || chr(10) || '| type | events | first | last |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || type || ' | ' || n || ' | ' || {_TIME('a')} || ' | ' || {_TIME('b')} || ' |', chr(10) ORDER BY type) || chr(10) AS document FROM p GROUP BY video""",
    "master_report": timelines._WITH + f"SELECT video, '| ' || video || ' | ' || count(*) || ' | ' || {_TIME('max(timestamp)')} || ' |' AS line FROM timeline WHERE video IS NOT NULL GROUP BY video",
    "render_html": timelines._WITH.rstrip() + f""", r AS (SELECT video, CAST(floor(greatest(timestamp, 0) / 3600) AS INT) AS part, timestamp, CASE type WHEN 'speech' THEN 0 ELSE 1 END AS rank, seq, '<tr><td>' || {_TIME('timestamp')} || '</td><td>' || type || '</td><td>' || {_ESCAPED} || '</td></tr>' AS line FROM timeline WHERE video IS NOT NULL)
 SELECT video, part, '<!DOCTYPE html>' || chr(10) || '<title>' || video || '</title>' || chr(10) || '<table>' || chr(10) || string_agg(line, chr(10) ORDER BY timestamp, rank, seq, line) || chr(10) || '</table>' || chr(10) AS document FROM r GROUP BY video, part""",
}

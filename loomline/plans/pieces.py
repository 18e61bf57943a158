"""Queries of the small operators: frames, boxes, words, metadata, choices, exit codes, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import caption_language_key, parse_caption_time, strip_cue_markup
from loomline.operators import boxes, captions, fusion, quality, regions, state
from loomline.plans.files import _folder
from loomline.plans.text import _strip
from loomline.session import table
from loomline.sources import frames, readers
from loomline.streaming.stateful import activity_episodes


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Orders as recordings of up to 40 frames at 0 to 24 frames a second."""
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(key.alias("video"), (key % 41).alias("frames"), ((key % 5) * 6).cast("double").alias("fps"), ((key % 3) - 1).cast("double").alias("probed"))


def video_durations(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).select("video", frames.duration_s(F.col("frames"), F.col("fps"), F.col("probed")).alias("duration"))


def frame_times(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_times(_clips(spark, d)).select("video", "frame_index", F.round("timestamp", 6).alias("timestamp"))


def scene_sample_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.sampled_for_scenes(_clips(spark, d)).select("video", "frame_index")


def evidence_names(spark: SparkSession, d: str) -> DataFrame:
    """Times in whole milliseconds, so that no rounding is in doubt."""
    return table(spark, d, "events").select("event_id", boxes.evidence_name(F.col("event_id"), (F.col("event_id") % 100_000) / 8).alias("name"))


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_event").filter("boxes IS NOT NULL").select("event_id", "boxes").dropDuplicates(["event_id"])


def polygon_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles as polygons for even places, as rows of four sides for odd ones, and cut short where the place divides by five."""
    rows = _boxed(spark, d).select("event_id", F.posexplode("boxes").alias("pos", "b"))
    x1, y1, x2, y2 = (F.coalesce(F.col(f"b.{k}"), F.lit(0)) + 0.25 for k in ("x1", "y1", "x2", "y2"))
    points = F.when(F.col("pos") % 5 == 4, F.array(F.array(x1, y1))).when(F.col("pos") % 2 == 0, F.array(F.array(x1, y2), F.array(x2, y1), F.array(x2, y2), F.array(x1, y1))).otherwise(F.array(F.array(x1, y1, x2, y2)))
    return rows.select("event_id", "pos", boxes.box_rectangle(points).alias("r")).select("event_id", "pos", "r.x1", "r.y1", "r.x2", "r.y2")


def typed_words(spark: SparkSession, d: str) -> DataFrame:
    """A segment's words with times as strings, one in three of them no number."""
    rows = table(spark, d, "transcript_segment").filter("text IS NOT NULL").dropDuplicates(["segment_id"])
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(F.when(i % 3 == 2, F.lit("n/a")).otherwise(i.cast("string")).alias("start"), F.concat(i.cast("string"), F.lit(".5")).alias("end"), F.when(i % 4 == 3, F.lit(None)).otherwise(w).alias("word"), F.lit(None).cast("string").alias("probability")))
    return rows.select("segment_id", F.posexplode(readers.serialized_words(words)).alias("pos", "w")).select("segment_id", "pos", "w.start", "w.end", "w.word", "w.probability")


def timeline_details(spark: SparkSession, d: str) -> DataFrame:
    seg = table(spark, d, "transcript_segment").filter("start_s IS NOT NULL").select(F.col("video_id").alias("video"), F.col("segment_id").alias("seq"), F.split("text", " ").alias("words")).dropDuplicates(["seq"])
    obs = table(spark, d, "ocr_event").filter("timestamp_s IS NOT NULL").select(F.col("video_id").alias("video"), F.col("event_id").alias("seq"), F.coalesce("code_likelihood", F.lit(False)).alias("is_code"), "lines").dropDuplicates(["seq"])
    found = fusion.event_details(seg, obs)
    return found.select("type", "seq", F.coalesce(F.try_element_at("metadata", F.lit("word_count")), F.try_element_at("metadata", F.lit("line_count"))).cast("long").alias("n"), F.map_keys("metadata")[0].alias("of"))


def skipped_before(spark: SparkSession, d: str) -> DataFrame:
    """Recordings whose model and requested language have a passed run of the same version."""
    keys = ["video_id", "requested_language", "model"]
    meta = table(spark, d, "video_metadata").select(*keys, F.when(F.col("language_probability") > 0.6, "passed").otherwise("failed").alias("status"))
    return state.passed_before(meta.select(*keys).distinct(), meta, keys)


def batch_exit_code(spark: SparkSession, d: str) -> DataFrame:
    return quality.batch_exit_code(table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("ok")))


def retry_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first two lines of an order as two attempts, quantity as the score."""
    n = F.col("l_linenumber").cast("int")
    rows = table(spark, d, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("key"), (n - 1).alias("attempt"), F.when(F.col("l_returnflag") == "N", "passed").otherwise("review_required").alias("status"), F.col("l_quantity").cast("int").alias("score"))
    return quality.keep_retry(rows)


def playlist_first(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 entries of a range: a limit is this operator's feature."""
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 50).cast("int").alias("playlist_index"))
    return captions.playlist_entries(entries, 3, 40, 25).select("position", F.col("original_index").cast("long").alias("index"))


def change_classes(spark: SparkSession, d: str) -> DataFrame:
    added, removed = F.col("l_linenumber").cast("int") - 1, (F.col("l_quantity") % 4).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", regions.change_class(added, removed).alias("change"))


def optional_numbers(spark: SparkSession, d: str) -> DataFrame:
    """What isn't a number is null."""
    value = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", value.try_cast("double").alias("number"))


def cue_markup(spark: SparkSession, d: str) -> DataFrame:
    """Titles with tags, times and references of every kind around them."""
    raw = F.concat(F.lit("<c.x>&eacute;&#8364; "), F.replace("title", F.lit(" "), F.lit("&nbsp;")), F.lit("</c> <00:00:01.500>&amp;lt; &#x41;&copy 3 &unknown;"))
    return table(spark, d, "video_metadata").select("video_id", strip_cue_markup(raw).alias("line")).distinct()


def caption_times(spark: SparkSession, d: str) -> DataFrame:
    """H:M:S, M:S and what is neither."""
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, F.concat_ws(":", n % 30, n % 60, F.lit("07.250"))).when(n % 4 == 1, F.concat(F.lit(" "), (n % 60).cast("string"), F.lit(":09.5 align:start"))).when(n % 4 == 2, F.lit("12")).otherwise(F.lit("a:b"))
    return table(spark, d, "events").select("event_id", parse_caption_time(raw).alias("seconds"))


def track_families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang IS NOT NULL").groupBy(caption_language_key("lang").alias("family")).agg(F.count("*").alias("n"))


def _downloads(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".srt", ".vtt", ".m4a", ".webm.part", ".webm", ".m4a.ytdl", ".info.json")]), F.col("l_linenumber").cast("int"))
    return table(spark, d, "lineitem").filter("l_linenumber <= 7").select(F.col("l_orderkey").alias("video"), F.concat(F.col("l_suppkey").cast("string"), suffix).alias("name"))


def caption_file_choice(spark: SparkSession, d: str) -> DataFrame:
    return state.pick_caption_file(_downloads(spark, d).filter("name LIKE '%.vtt' OR name LIKE '%.srt' OR name LIKE '%.part'"))


def cached_audio(spark: SparkSession, d: str) -> DataFrame:
    return state.pick_cached_audio(_downloads(spark, d))


def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as episodes of activity that end after two hours without any."""
    events = table(spark, d, "events").select(F.col("user_id").alias("video"), "ts")
    found = activity_episodes(events, "ts", "2 hours")
    return found.select("video", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n_changes")


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    """Regions as media of a decoder whose pictures are the letters of their names."""

    def decoder(content: bytes):
        return 0.0 if len(content) % 2 else 5.0, ((1, 1, content[i : i + 1]) for i in range(len(content)))

    media = table(spark, d, "region").select(F.col("r_name").alias("path"), F.col("r_name").cast("binary").alias("content"))
    return frames.read_frames(media, decoder).select("path", "frame_index", F.round("timestamp", 6).alias("timestamp"), F.col("pixels").cast("string").alias("letter"))


def evidence_files(spark: SparkSession, d: str) -> DataFrame:
    """Nations' names as pictures, written to the shared folder and read back."""
    folder = _folder(spark).removeprefix("file:").replace("///", "/")
    rows = table(spark, d, "nation").select(boxes.evidence_name(F.col("n_nationkey"), F.lit(0.5)).alias("name"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.col("n_name").cast("binary").alias("pixels"))
    frames.write_evidence(rows, folder, lambda h, w, pixels: pixels).write.format("noop").mode("overwrite").save()
    found = spark.read.format("binaryFile").load(f"file://{folder}")
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("content").cast("string").alias("content"))


def found_videos(spark: SparkSession, d: str) -> DataFrame:
    """Nations as files of several suffixes in a folder, its subfolder and its output folder: the recordings among them."""
    folder = _folder(spark).removeprefix("file:").replace("///", "/")
    key = F.col("n_nationkey")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MKV", ".txt", ".Mov", ".vtt")]), (key % 5 + 1).cast("int"))
    rows = table(spark, d, "nation").select(F.concat("n_name", suffix).alias("name"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.col("n_name").cast("binary").alias("pixels"), (key % 3).alias("place"))
    for place, below in enumerate(("", "/more", "/output")):
        frames.write_evidence(rows.filter(F.col("place") == place), folder + below, lambda h, w, pixels: pixels).write.format("noop").mode("overwrite").save()
    return readers.find_videos(spark, f"file://{folder}", "output").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


_ALL = (
    found_videos, video_durations, frame_times, scene_sample_frames, evidence_names, polygon_boxes, typed_words, timeline_details, skipped_before, batch_exit_code, retry_choice, playlist_first, change_classes,
    optional_numbers, cue_markup, caption_times, track_families, caption_file_choice, cached_audio, activity_sessions, frame_rows, evidence_files,
)
QUERIES = {f.__name__: f for f in _ALL}

_CLIPS = "WITH c AS (SELECT o_orderkey AS video, o_orderkey % 41 AS frames, CAST((o_orderkey % 5) * 6 AS DOUBLE) AS fps, CAST(o_orderkey % 3 - 1 AS DOUBLE) AS probed FROM orders), t AS (SELECT video, unnest(range(frames)) AS frame_index, CASE WHEN fps > 0 THEN fps ELSE 30.0 END AS fps FROM c) "
_BOXED = "WITH e AS (SELECT event_id, any_value(boxes) AS boxes FROM ocr_event WHERE boxes IS NOT NULL GROUP BY 1), b AS (SELECT event_id, unnest(boxes) AS b, generate_subscripts(boxes, 1) - 1 AS pos FROM e) "
_FILES = "WITH f AS (SELECT l_orderkey AS video, l_suppkey || ['.srt', '.vtt', '.m4a', '.webm.part', '.webm', '.m4a.ytdl', '.info.json'][l_linenumber] AS name FROM lineitem WHERE l_linenumber <= 7) "
SQL = {
    "found_videos": "SELECT n_name || ['.mp4', '.MKV', '.txt', '.Mov', '.vtt'][n_nationkey % 5 + 1] AS name, length(n_name) AS length FROM nation WHERE n_nationkey % 5 IN (0, 1, 3) AND n_nationkey % 3 <> 2",
    "video_durations": _CLIPS + "SELECT video, CASE WHEN frames > 0 AND fps > 0 THEN frames / fps WHEN probed > 0 THEN probed ELSE 0.0 END AS duration FROM c",
    "frame_times": _CLIPS + "SELECT video, frame_index, round(frame_index / fps, 6) AS timestamp FROM t",
    "scene_sample_frames": _CLIPS + "SELECT video, frame_index FROM t WHERE (frame_index + 1) % greatest(1, CAST(floor(fps * 0.5) AS BIGINT)) = 0",
    "evidence_names": "SELECT event_id, lpad(CAST(event_id AS VARCHAR), 6, '0') || '_' || lpad(CAST((event_id % 100000) // 8 AS VARCHAR), 8, '0') || '.' || lpad(CAST(event_id % 100000 % 8 * 125 AS VARCHAR), 3, '0') || 's.jpg' AS name FROM events",
    "polygon_boxes": _BOXED + "SELECT event_id, pos, " + ", ".join(f"CASE WHEN pos % 5 <> 4 THEN CAST(trunc({side}) AS INT) END AS {k}" for k, side in (
        ("x1", "CASE WHEN pos % 2 = 0 THEN least(coalesce(b.x1, 0), coalesce(b.x2, 0)) ELSE coalesce(b.x1, 0) END + 0.25"), ("y1", "CASE WHEN pos % 2 = 0 THEN least(coalesce(b.y1, 0), coalesce(b.y2, 0)) ELSE coalesce(b.y1, 0) END + 0.25"),
        ("x2", "CASE WHEN pos % 2 = 0 THEN greatest(coalesce(b.x1, 0), coalesce(b.x2, 0)) ELSE coalesce(b.x2, 0) END + 0.25"), ("y2", "CASE WHEN pos % 2 = 0 THEN greatest(coalesce(b.y1, 0), coalesce(b.y2, 0)) ELSE coalesce(b.y2, 0) END + 0.25"),
    )) + " FROM b",
    "typed_words": """WITH s AS (SELECT segment_id, any_value(text) AS text FROM transcript_segment WHERE text IS NOT NULL GROUP BY 1), w AS (SELECT segment_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM s)
 SELECT segment_id, pos, CASE WHEN pos % 3 <> 2 THEN CAST(pos AS DOUBLE) END AS "start", pos + 0.5::DOUBLE AS "end", CASE WHEN pos % 4 = 3 THEN '' ELSE word END AS word, CAST(NULL AS DOUBLE) AS probability FROM w""",
    "timeline_details": """SELECT 'speech' AS type, segment_id AS seq, any_value(coalesce(len(string_split(text, ' ')), 0)) AS n, 'word_count' AS of FROM transcript_segment WHERE start_s IS NOT NULL GROUP BY segment_id
 UNION ALL SELECT any_value(CASE WHEN code_likelihood THEN 'code' ELSE 'ocr' END), event_id, any_value(coalesce(len(lines), 0)), 'line_count' FROM ocr_event WHERE timestamp_s IS NOT NULL GROUP BY event_id""",
    "skipped_before": "SELECT DISTINCT video_id, requested_language, model FROM video_metadata WHERE language_probability > 0.6 AND video_id IS NOT NULL AND requested_language IS NOT NULL AND model IS NOT NULL",
    "batch_exit_code": "SELECT count(*) AS found, count(*) FILTER (c_acctbal > 0) AS ok, count(*) - count(*) FILTER (c_acctbal > 0) AS failed, CASE WHEN count(*) = 0 THEN 1 WHEN count(*) FILTER (c_acctbal > 0) < count(*) THEN 3 ELSE 0 END AS exit_code FROM customer",
    "retry_choice": """WITH r AS (SELECT l_orderkey AS key, l_linenumber - 1 AS attempt, CASE l_returnflag WHEN 'N' THEN 'passed' ELSE 'review_required' END AS status, CAST(l_quantity AS INT) AS score FROM lineitem WHERE l_linenumber <= 2),
 p AS (SELECT key, max(CASE WHEN attempt = 0 THEN {'attempt': attempt, 'status': status, 'score': score} END) AS a, max(CASE WHEN attempt = 1 THEN {'attempt': attempt, 'status': status, 'score': score} END) AS b FROM r GROUP BY key),
 x AS (SELECT key, CASE WHEN a IS NULL OR (b IS NOT NULL AND a.status <> 'passed' AND b.score >= a.score) THEN b ELSE a END AS x FROM p) SELECT key, x.attempt AS attempt, x.status AS status, x.score AS score FROM x""",
    "playlist_first": "WITH e AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey ELSE o_orderkey % 50 END AS index FROM orders) SELECT position, index FROM e WHERE index BETWEEN 3 AND 40 ORDER BY index, position LIMIT 25",
    "change_classes": """WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS a, CAST(l_quantity AS INT) % 4 AS r FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN r = 0 OR a > 2 * r THEN 'addition' WHEN a = 0 OR r > 2 * a THEN 'deletion' ELSE 'modification' END AS change FROM c""",
    "optional_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_totalprice AS DOUBLE) END AS number FROM orders",
    "cue_markup": f"SELECT DISTINCT video_id, {_strip("regexp_replace('é€ ' || title || ' &lt; A© 3 &unknown;', '\\s+', ' ', 'g')")} AS line FROM video_metadata",
    "caption_times": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 30) * 3600 + (event_id % 60) * 60 + 7.25 WHEN 1 THEN (event_id % 60) * 60 + 9.5 END::DOUBLE AS seconds FROM events",
    "track_families": "SELECT split_part(replace(lower(lang), '_', '-'), '-', 1) AS family, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "caption_file_choice": _FILES + "SELECT video, arg_min(name, (CASE WHEN ends_with(name, '.vtt') THEN '0' ELSE '1' END) || name) AS name FROM f WHERE ends_with(name, '.vtt') OR ends_with(name, '.srt') GROUP BY video",
    "cached_audio": _FILES + "SELECT video, min(name) AS name FROM f WHERE ends_with(name, '.m4a') OR ends_with(name, '.webm') GROUP BY video",
    "activity_sessions": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL),
 s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM e)
 SELECT user_id AS video, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n_changes FROM s GROUP BY user_id, n""",
    "frame_rows": "WITH r AS (SELECT r_name AS path, unnest(range(length(r_name))) AS i FROM region) SELECT path, i AS frame_index, round(i / CASE WHEN length(path) % 2 = 1 THEN 30.0 ELSE 5.0 END, 6) AS timestamp, substr(path, CAST(i + 1 AS INT), 1) AS letter FROM r",
    "evidence_files": "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') || '_00000000.500s.jpg' AS name, n_name AS content FROM nation",
}

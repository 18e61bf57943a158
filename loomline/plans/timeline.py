"""Timeline queries: fusion, context, search, scenes, deduplication, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.fixed import SPACE
from loomline.operators import fusion, golden, search, sequence
from loomline.session import table


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return fusion.segments_of(table(spark, d, "transcript_segment"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return fusion.observations_of(table(spark, d, "ocr_event"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(fusion.speech_events(_segments(spark, d)), fusion.screen_events(_observations(spark, d)))


def timeline_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.order_timeline(timeline(spark, d)).select("video", "timestamp", F.round("duration", 3).alias("duration"), "type", "source", "text", "confidence", "seq")


def timeline_event_id(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).select("video", "type", "seq", fusion.event_id().alias("id"))


def speech_context_bucketed(spark: SparkSession, d: str) -> DataFrame:
    return fusion.speech_context(_observations(spark, d), _segments(spark, d), range_s=30.0)


def _search(query: str, types: list[str] | None = None, case_sensitive: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.ordered(search.search(timeline(spark, d), query, types, case_sensitive)).select("video", "timestamp", "type", "source", "text", "context", "seq")

    return run


def search_fallback_sources(spark: SparkSession, d: str) -> DataFrame:
    """Videos with screen events have a timeline; the others are searched in their transcripts."""
    seg, obs = _segments(spark, d), _observations(spark, d)
    have = obs.select("video").distinct()
    fused = fusion.fuse(fusion.speech_events(seg), fusion.screen_events(obs)).join(have, "video", "left_semi")
    return search.with_fallback(fused, seg, obs, "the", ["speech"]).select("video", "timestamp", "context", "seq")


def search_report(spark: SparkSession, d: str) -> DataFrame:
    return search.report_lines(search.search(timeline(spark, d), "server")).select("video", "seq", "header", "line")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("double").alias("timestamp"), F.col("embedding").alias("signature"))


def scene_changes(spark: SparkSession, d: str) -> DataFrame:
    return sequence.scene_changes(_frames(spark, d), 0.14).select("video", "seq", F.round("difference", 6).alias("difference"))


def ocr_dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return sequence.keep_changed(_observations(spark, d), similarity=0.45, heartbeat=20.0).select("video", "seq")


def bigram_similarity_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return sequence.consecutive_similarity(_observations(spark, d)).select("video", "seq", F.round("similarity", 6).alias("similarity"))


def _event_frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("video"), F.col("event_id").alias("seq"), F.col("value"))


def adaptive_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames a tenth of a second apart by id, their value as a one-number signature."""
    frames = _event_frames(spark, d).select("video", "seq", (F.col("seq") / 10).alias("timestamp"), (F.col("value") / 100).alias("value"))
    return sequence.adaptive_sample(frames, threshold=0.5).select("video", "seq", F.round("difference", 6).alias("difference"))


def dark_frame_filter(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("value") % 20).alias("luma"), (F.col("event_id") % 1000 / 1000).alias("difference"))
    return sequence.dark_frames_removed(frames).select("seq")


def resume_high_water(spark: SparkSession, d: str) -> DataFrame:
    obs = _observations(spark, d)
    marks = table(spark, d, "transcript").filter("chunk_no = 0").select(F.col("video_id").alias("video"), (F.col("transcript_id") % 7 * 60.0).alias("mark"))
    return sequence.after_mark(obs, marks).select("video", "seq")


def golden_match(spark: SparkSession, d: str) -> DataFrame:
    """Screen events as annotations of one type, matched with what was said nearest to them."""
    marks = _observations(spark, d).select("video", "seq", "timestamp", F.lit("any").alias("type"), "text")
    said = _segments(spark, d).select("video", "seq", F.col("start").alias("timestamp"), F.lit("any").alias("type"), "text")
    return golden.match(marks, said, 10.0).select("seq", "match", F.round("time_error", 3).alias("time_error"))


def extractor_union(spark: SparkSession, d: str) -> DataFrame:
    from loomline.operators.extractors import Registry, SceneExtractor, StreamExtractor

    registry = Registry()
    registry.register(StreamExtractor("speech", lambda inputs: fusion.speech_events(inputs["segments"])))
    registry.register(StreamExtractor("screen", lambda inputs: fusion.screen_events(inputs["observations"])))
    registry.register(SceneExtractor(0.14))
    registry.register(StreamExtractor("broken", lambda inputs: inputs["absent"]))
    return registry.run_all({"segments": _segments(spark, d), "observations": _observations(spark, d), "frames": _frames(spark, d)}).select("video", "timestamp", "type", "seq")


_WITH = """
WITH seg AS (SELECT DISTINCT video_id AS video, segment_id AS seq, start_s AS s0, end_s AS e0, text FROM transcript_segment WHERE start_s IS NOT NULL),
obs AS (SELECT DISTINCT video_id AS video, event_id AS seq, timestamp_s AS t, text, coalesce(code_likelihood, false) AS is_code, mean_confidence AS confidence FROM ocr_event WHERE timestamp_s IS NOT NULL),
timeline AS (SELECT video, s0 AS timestamp, e0 - s0 AS duration, 'speech' AS type, 'whisper' AS source, text, CAST(NULL AS DOUBLE) AS confidence, seq FROM seg
  UNION ALL SELECT video, t, NULL, CASE WHEN is_code THEN 'code' ELSE 'ocr' END, 'paddleocr', text, confidence, seq FROM obs)
"""


def sql_time(x: str) -> str:
    """format_time of a non-negative expression."""
    ms = f"CAST(round(({x} - floor({x} / 60) * 60) * 1000) AS BIGINT)"
    tail = f"lpad(CAST(CAST(floor({x} / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"
    hours = f"CAST(floor({x} / 3600) AS BIGINT)"
    return f"(CASE WHEN {hours} > 0 THEN lpad(CAST({hours} AS VARCHAR), 2, '0') || ':' ELSE '' END || {tail})"


def sql_norm(x: str) -> str:
    """normalize_screen_text."""
    quotes = f"translate(lower({x}), '“”‘’', '\"\"''''')"
    single = f"regexp_replace({quotes}, '{SPACE}+', ' ', 'g')"
    tight = f"regexp_replace({single}, '[ \\t]*([{{}}()\\[\\];,:.=+\\-*/<>])[ \\t]*', '\\1', 'g')"
    return f"regexp_replace({tight}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_grams(n: str) -> str:
    return f"(CASE WHEN length({n}) <= 1 THEN [{n}] ELSE list_distinct(list_transform(range(1, length({n})), lambda i: substr({n}, i, 2))) END)"


def sql_similarity(ga: str, gb: str, a: str, b: str) -> str:
    both = f"len(list_intersect({ga}, {gb}))"
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE CAST({both} AS DOUBLE) / (len({ga}) + len({gb}) - {both}) END)"


def _search_sql(query: str, types: list[str] | None = None, case_sensitive: bool = False) -> str:
    t = "coalesce(text, '')"
    hay = t if case_sensitive else f"lower({t})"
    at = f"(strpos({hay}, '{query if case_sensitive else query.lower()}') - 1)" if query else "0"
    begin = f"greatest({at} - 40, 0)"
    where = f"contains({hay}, '{query if case_sensitive else query.lower()}')" + (f" AND type IN ({', '.join(repr(x) for x in types)})" if types else "")
    return _WITH + f"SELECT video, timestamp, type, source, substr({t}, 1, 200) AS text, substr({t}, {begin} + 1, least(length({t}), {at} + {len(query)} + 40) - {begin}) AS context, seq FROM timeline WHERE {where}"


_PIECE = f"'[' || {sql_time('s0')} || ' → ' || {sql_time('coalesce(e0, s0)')} || '] ' || coalesce(s.text, '')"
_CONTEXT = _WITH + f"""SELECT o.video, o.seq, coalesce(string_agg({_PIECE}, ' ' ORDER BY s.seq), '') AS context
FROM obs o LEFT JOIN seg s ON o.video = s.video AND greatest(coalesce(e0, s0), s0) >= o.t - 10 AND s0 <= o.t + 10 GROUP BY o.video, o.seq"""

_SCENES = """SELECT video, vec_id AS seq, round(difference, 6) AS difference FROM (
 SELECT 'v' || label AS video, vec_id, coalesce(list_sum(list_transform(list_zip(embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) / len(embedding), 1.0) AS difference,
 row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE difference >= 0.14 OR n = 1"""

_QUERIES_SEARCH = {
    "search_ci": ("SERVER",), "search_cs": ("Server", None, True), "search_by_type": ("return", ["code"]), "search_snippet": ("between",), "search_empty_query": ("",),
}

QUERIES = {
    f.__name__: f
    for f in (
        timeline_fusion, timeline_event_id, speech_context_bucketed, search_fallback_sources, search_report, scene_changes,
        ocr_dedup_keep_last, bigram_similarity_consecutive, adaptive_sampling, dark_frame_filter, resume_high_water, extractor_union, golden_match,
    )
} | {k: _search(*v) for k, v in _QUERIES_SEARCH.items()}

SQL = {k: _search_sql(*v) for k, v in _QUERIES_SEARCH.items()} | {
    "timeline_fusion": _WITH + "SELECT video, timestamp, round(duration, 3) AS duration, type, source, text, confidence, seq FROM timeline",
    "timeline_event_id": _WITH + "SELECT video, type, seq, substr(sha256(video || '|' || type || '|' || source || '|' || CAST(seq AS VARCHAR)), 1, 12) AS id FROM timeline",
    "speech_context_bucketed": _CONTEXT,
    "search_fallback_sources": _search_sql("the", ["speech"]).replace("SELECT video, timestamp, type, source, substr(coalesce(text, ''), 1, 200) AS text, ", "SELECT video, timestamp, "),
    "search_report": _WITH + f"""SELECT video, seq, CASE WHEN row_number() OVER (PARTITION BY video ORDER BY timestamp, seq) = 1 THEN '── ' || video || ' ──' END AS header,
 '  [' || {sql_time('timestamp')} || '] ' || rpad(upper(type), 8, ' ') || ' | ' || substr(text, 1, 120) || CASE WHEN coalesce(confidence, 0) <> 0 THEN printf(' conf=%.3f', confidence) ELSE '' END AS line
 FROM timeline WHERE contains(lower(coalesce(text, '')), 'server')""",
    "scene_changes": _SCENES,
    "ocr_dedup_keep_last": _WITH.replace("WITH seg", "WITH RECURSIVE seg").rstrip() + f""",
 n AS (SELECT video, seq, t, {sql_norm("text")} AS norm, row_number() OVER (PARTITION BY video ORDER BY t, seq) AS k FROM obs WHERE length(trim(text)) >= 4),
 g AS (SELECT *, {sql_grams("norm")} AS grams FROM n),
 r AS (SELECT video, k, seq, true AS kept, t AS at, norm, grams FROM g WHERE k = 1
  UNION ALL SELECT q.video, q.k, q.seq, q.take, CASE WHEN q.take THEN q.t ELSE q.at END, CASE WHEN q.take THEN q.norm ELSE q.norm0 END, CASE WHEN q.take THEN q.grams ELSE q.grams0 END
  FROM (SELECT g.video, g.k, g.seq, g.t, g.norm, g.grams, r.at, r.norm AS norm0, r.grams AS grams0, {sql_similarity("r.grams", "g.grams", "r.norm", "g.norm")} < 0.45 OR g.t - r.at >= 20 AS take FROM r JOIN g ON g.video = r.video AND g.k = r.k + 1) q)
 SELECT video, seq FROM r WHERE kept""",
    "bigram_similarity_consecutive": _WITH.rstrip() + f""", n AS (SELECT video, seq, {sql_norm("coalesce(text, '')")} AS norm, t FROM obs), g AS (SELECT *, {sql_grams("norm")} AS grams FROM n),
 p AS (SELECT *, lag(norm) OVER w AS norm0, lag(grams) OVER w AS grams0 FROM g WINDOW w AS (PARTITION BY video ORDER BY t, seq))
 SELECT video, seq, round({sql_similarity("grams0", "grams", "norm0", "norm")}, 6) AS similarity FROM p WHERE norm0 IS NOT NULL""",
    "adaptive_sampling": """WITH RECURSIVE f AS (SELECT 'v' || (user_id % 20) AS video, event_id AS seq, event_id / 10 AS t, value / 100 AS v, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
 r AS (SELECT video, k, seq, true AS taken, CAST(1.0 AS DOUBLE) AS difference, v AS last, t + 8.0 AS until, t + 0.5 AS due FROM f WHERE k = 1
  UNION ALL SELECT video, k, seq, take, difference, CASE WHEN take THEN v ELSE last END, until, CASE WHEN take THEN t + CASE WHEN t < until THEN 0.5 ELSE 2.0 END ELSE due END
  FROM (SELECT *, CASE WHEN take AND difference >= 0.5 THEN greatest(until0, t + 8.0) ELSE until0 END AS until
   FROM (SELECT f.video, f.k, f.seq, f.t, f.v, r.last, r.until AS until0, r.due, abs(f.v - r.last) AS difference, f.t + 0.01 >= r.due AS take FROM r JOIN f ON f.video = r.video AND f.k = r.k + 1)))
 SELECT video, seq, round(difference, 6) AS difference FROM r WHERE taken""",
    "golden_match": _WITH.rstrip() + """, p AS (SELECT o.seq, s.seq AS m, abs(s.s0 - o.t) AS dt, row_number() OVER (PARTITION BY o.seq ORDER BY abs(s.s0 - o.t), s.seq) AS k FROM obs o LEFT JOIN seg s ON s.video = o.video AND abs(s.s0 - o.t) <= 10)
 SELECT seq, m AS match, round(dt, 3) AS time_error FROM p WHERE k = 1""",
    "dark_frame_filter": "SELECT event_id AS seq FROM events WHERE NOT (value % 20 < 8 AND event_id % 1000 / 1000 < 0.065 * 1.5)",
    "resume_high_water": _WITH.rstrip() + """, m AS (SELECT video_id AS video, transcript_id % 7 * 60.0 AS mark FROM transcript WHERE chunk_no = 0)
 SELECT obs.video, obs.seq FROM obs LEFT JOIN m ON m.video = obs.video WHERE mark IS NULL OR t > mark""",
    "extractor_union": _WITH + "SELECT video, timestamp, type, seq FROM timeline UNION ALL SELECT video, CAST(seq AS DOUBLE), 'scene', seq FROM (" + _SCENES + ")",
}

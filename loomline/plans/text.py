"""Text, code, quality, caption, box and state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import code, fixed, text
from loomline.functions.fixed import SPACE
from loomline.operators import boxes, captions, fusion, quality, regions, state
from loomline.plans.timeline import sql_norm, sql_time
from loomline.session import table


def _read_events(spark: SparkSession, d: str) -> DataFrame:
    """Screen events as they are stored, repeated rows too."""
    return table(spark, d, "ocr_event").select(F.col("event_id").alias("doc"), "video_id", "timestamp_s", "text", "code_likelihood")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Each event once: for what needs the texts themselves in order or in groups."""
    return _read_events(spark, d).dropDuplicates(["doc"])


def _per_event(spark: SparkSession, d: str, *columns) -> DataFrame:
    """What is computed of each event's text, repeated rows once: they go after the text is gone, so no text is shuffled."""
    return _read_events(spark, d).select("doc", *columns).dropDuplicates(["doc"])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.clean_text("text").alias("cleaned"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _per_event(spark, d, text.normalize_screen_text("text").alias("normalized"))


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "video_metadata").drop("generated_at_utc").distinct()


def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return _videos(spark, d).select("video_id", text.safe_filename("title").alias("name")).distinct()


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _videos(spark, d).select("video_id", text.slugify("title").alias("slug")).distinct()


def format_times(spark: SparkSession, d: str) -> DataFrame:
    seg = fusion.segments_of(table(spark, d, "transcript_segment"))
    return seg.select("seq", text.format_time("start").alias("plain"), text.format_srt_time("start").alias("srt"), text.format_vtt_time("start").alias("vtt"))


def looks_like_code(spark: SparkSession, d: str) -> DataFrame:
    return _per_event(spark, d, code.looks_like_code(F.col("text")).alias("is_code"))


def is_code_block(spark: SparkSession, d: str) -> DataFrame:
    return _per_event(spark, d, code.is_code_block(F.col("text")).alias("is_code"))


def code_line_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = _per_event(spark, d, F.transform(F.split("text", "\n"), code.is_code_line).alias("flags"))
    return flags.select("doc", F.posexplode("flags").alias("pos", "is_code"))


def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _per_event(spark, d, code.programming_language(F.col("text")).alias("best")).select("doc", F.col("best.language").alias("language"), F.col("best.score").alias("score"))


def code_regions(spark: SparkSession, d: str) -> DataFrame:
    found = regions.code_regions(_events(spark, d).select("doc", "text"))
    return found.select("doc", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "text", "language", "indented")


def region_boxes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "ocr_event").select(F.col("event_id").alias("doc"), "text", "boxes").dropDuplicates(["doc"])
    return regions.region_boxes(regions.code_regions(events.select("doc", "text")), events).select("doc", "start_line", "x1", "y1", "x2", "y2")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter("code_likelihood AND timestamp_s IS NOT NULL").select(F.col("video_id").alias("video"), F.col("doc").alias("seq"), F.col("timestamp_s").alias("timestamp"), "text")


def code_diff_class(spark: SparkSession, d: str) -> DataFrame:
    return regions.version_chain(_snapshots(spark, d))


def code_versions(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots that differ from the version before, without the difference itself."""
    return regions.differing(_snapshots(spark, d)).drop("prev_text", "text")


def code_histories(spark: SparkSession, d: str) -> DataFrame:
    """Each video's versions as one readable history."""
    return regions.evolutions(_snapshots(spark, d))


def code_evolution(spark: SparkSession, d: str) -> DataFrame:
    return regions.evolution_lines(regions.version_chain(_snapshots(spark, d)))


def temporal_vote(spark: SparkSession, d: str) -> DataFrame:
    """Each code text, repaired where more than half of its video's code texts of the minute before show the repaired form."""
    events = _events(spark, d).filter("code_likelihood").select(F.col("video_id").alias("video"), F.col("doc").alias("seq"), F.col("timestamp_s").alias("timestamp"), "text")
    return regions.with_earlier(events).select(F.col("seq").alias("doc"), regions.repair_by_vote(F.col("text"), F.col("earlier")).alias("repaired"))


def _transcript_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcript_segment").filter("transcript_id IS NOT NULL").groupBy("transcript_id").agg(F.max("video_id").alias("video_id"), (F.max("end_s") - F.min("start_s")).alias("duration"))
    sure = table(spark, d, "video_metadata").groupBy("video_id").agg(F.max("language_probability").alias("language_probability"))
    return rows.join(sure, "video_id", "left").select("transcript_id", "language_probability", "duration")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    seg = table(spark, d, "transcript_segment").select("transcript_id", F.col("segment_id").alias("seq"), "text", "quality").dropDuplicates(["seq"])
    return quality.report(seg, "transcript_id", _transcript_facts(spark, d))


def quality_tokens(spark: SparkSession, d: str) -> DataFrame:
    seg = table(spark, d, "transcript_segment").select("transcript_id", "segment_id", "text").dropDuplicates(["segment_id"])
    return quality.tokens(seg, "transcript_id")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("transcript_id", "status", "score", F.array_join("flags", ",").alias("flags"), "segment_count", "text_chars", "token_count")


def quality_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("score").alias("points"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.run_summary(_quality(spark, d).select("status"))


def caption_vs_asr_choice(spark: SparkSession, d: str) -> DataFrame:
    """Per recording and kind the best transcript's quality as a candidate."""
    kinds = table(spark, d, "transcript").select("transcript_id", "video_id", F.when(F.col("transcription_source") == "caption_manual", "manual").when(F.col("transcription_source") == "caption_automatic", "automatic").otherwise("asr").alias("kind"))
    best = F.max(F.struct("score", "status")).alias("best")
    candidates = _quality(spark, d).join(kinds, "transcript_id").groupBy(F.col("video_id").alias("key"), "kind").agg(best).select("key", "kind", "best.status", "best.score")
    return quality.choose_source(candidates).select(F.col("key").alias("video_id"), "kind", "status", "score")


def _cut_segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_segment").filter("start_s IS NOT NULL AND end_s IS NOT NULL AND transcript_id IS NOT NULL").select("transcript_id", F.col("segment_id").alias("seq"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def render_srt(spark: SparkSession, d: str) -> DataFrame:
    return captions.render_srt(_cut_segments(spark, d), "transcript_id")


def render_vtt(spark: SparkSession, d: str) -> DataFrame:
    return captions.render_vtt(_cut_segments(spark, d), "transcript_id")


def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return captions.render_markdown(_cut_segments(spark, d), "transcript_id", F.concat(F.lit("transcript "), F.col("transcript_id").cast("string")))


def vtt_cues(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts rendered with markup, and each cue twice, then parsed again."""
    seg = _cut_segments(spark, d).withColumn("text", F.concat(F.lit("<c>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</c>")))
    files = captions.render_vtt(seg, "transcript_id").select(F.col("transcript_id").alias("doc"), F.col("document").alias("raw"))
    return captions.parse_vtt(files).select("doc", "start", "end", "text")


def vtt_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each cue written twice in a row, as rolling captions do, counts once."""
    twice = _cut_segments(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seq", F.col("seq") * 2 + F.col("copy")).drop("copy")
    files = captions.render_vtt(twice, "transcript_id").select(F.col("transcript_id").alias("doc"), F.col("document").alias("raw"))
    return captions.parse_vtt(files).groupBy("doc").agg(F.count("*").alias("n_cues"))


def caption_choice(spark: SparkSession, d: str) -> DataFrame:
    """Document languages as the caption tracks of their recording."""
    tracks = _docs(spark, d).filter("video_id IS NOT NULL AND lang IS NOT NULL AND source IN ('caption_manual', 'caption_automatic')").select(F.col("video_id").alias("key"), F.when(F.col("source") == "caption_manual", "manual").otherwise("automatic").alias("kind"), F.col("lang").alias("track"))
    declared = table(spark, d, "video_metadata").groupBy(F.col("video_id").alias("key")).agg(F.max("detected_language").alias("declared"))
    return captions.choose_track(tracks.distinct().join(declared, "key", "left")).select("key", "kind", "track")


def language_lookup(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("requested_language")
    return _videos(spark, d).select("video_id", captions.resolve_language(label).alias("code"), captions.language_name(captions.resolve_language(label)).alias("name"), F.coalesce(captions.is_known_alias(label), F.lit(False)).alias("known")).distinct()


def url_allowlist(spark: SparkSession, d: str) -> DataFrame:
    urls = _videos(spark, d).select("video_id", F.explode(F.array("url", F.concat(F.lit("https://www.YouTube.com/watch?v="), "video_id"), F.concat(F.lit("ftp://youtu.be/"), "video_id"), F.lit("not a url"))).alias("url"))
    return urls.select("video_id", "url", text.allowed_video_url("url").alias("allowed")).distinct()


def watch_url(spark: SparkSession, d: str) -> DataFrame:
    even = F.length("title") % 2 == 0
    return _videos(spark, d).select("video_id", text.watch_url(F.when(even, F.col("url")), "video_id").alias("watch")).distinct()


def playlist_range(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred entries with positions 3 to 12 over all playlists: a limit is this operator's feature."""
    entries = _videos(spark, d).select("video_id", "playlist_index", F.lit(1).alias("position")).distinct()
    return captions.playlist_entries(entries.withColumn("position", F.length("video_id")), 3, 12).select("video_id", F.col("original_index").alias("index"))


def playlist_index(spark: SparkSession, d: str) -> DataFrame:
    records = _videos(spark, d).select("video_id", "playlist_id", "playlist_index", "title", F.col("model").alias("status"), F.col("detected_language_name").alias("language_name"), F.lit(None).cast("string").alias("transcript_link")).distinct()
    return captions.playlist_index_lines(records)


def ocr_best_variant(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of an order as passes over one image: discount and tax make the confidence, quantity the characters."""
    variant = F.element_at(F.array(*[F.lit(v) for v in ("original", *fixed.IMAGE_VARIANTS)]), F.col("l_linenumber").cast("int"))
    passes = table(spark, d, "lineitem").filter("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("key"), variant.alias("variant")).agg((F.max(F.col("l_discount") + F.col("l_tax")) * 5).alias("confidence"), F.max("l_quantity").cast("int").alias("chars"))
    return boxes.best_variant(passes)


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_event").filter("boxes IS NOT NULL").select(F.col("event_id").alias("key"), "boxes").dropDuplicates(["key"])


def bbox_union(spark: SparkSession, d: str) -> DataFrame:
    return _boxed(spark, d).filter("size(boxes) > 0").select("key", boxes.union_rectangle(F.col("boxes")).alias("r")).select("key", "r.x1", "r.y1", "r.x2", "r.y2")


def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _boxed(spark, d).select("key", F.round(boxes.mean_confidence(F.col("boxes")) * F.size("boxes") * 10_000).cast("long").alias("sum_confidence"), boxes.joined_lines(F.col("boxes")).alias("text"))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return boxes.in_reading_order(_boxed(spark, d))


def _state(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as recorded stages of their order."""
    stage = F.element_at(F.array(*[F.lit(s) for s in fixed.STAGES]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    status = F.when(F.col("l_returnflag") == "N", "complete").when(F.col("l_returnflag") == "R", "partial").otherwise("running")
    return table(spark, d, "lineitem").filter("l_linenumber <= 5").select(F.col("l_orderkey").alias("video"), stage.alias("stage"), status.alias("status"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("video"))


def stage_state(spark: SparkSession, d: str) -> DataFrame:
    return state.stage_report(_orders(spark, d), _state(spark, d)).select("video", "report", F.col("n_complete").cast("long").alias("n_complete"))


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return state.left_to_do(_orders(spark, d), _state(spark, d), "ocr")


def identity_changed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files; what is stored has other heads where the id divides by seven."""
    now = _docs(spark, d).select(F.col("doc_id").alias("video"), F.col("n_chars").alias("size_bytes"), F.col("source").alias("modified_at"), state.head_hash("text").alias("head_hash")).fillna("")
    stored = now.withColumn("head_hash", F.when(F.col("video") % 7 == 0, "").otherwise(F.col("head_hash")))
    return state.changed(now, stored)


def recognition_speed(spark: SparkSession, d: str) -> DataFrame:
    """Per model: recordings, audio and elapsed milliseconds, and how many ran faster than real time."""
    rows = _videos(spark, d).filter("audio_duration > 0 AND elapsed_seconds IS NOT NULL").select("video_id", "model", "audio_duration", "elapsed_seconds").distinct()
    ms = lambda c: F.sum(F.round(F.col(c) * 1000).cast("long"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), ms("audio_duration").alias("audio_ms"), ms("elapsed_seconds").alias("elapsed_ms"), F.count_if(F.col("elapsed_seconds") / F.col("audio_duration") < 1).alias("faster"))


def golden_eval(spark: SparkSession, d: str) -> DataFrame:
    """Code flags against what the block heuristic says: hits, misses and false alarms."""
    rows = _per_event(spark, d, "code_likelihood", code.is_code_block(F.col("text")).alias("said")).filter("code_likelihood IS NOT NULL")
    return rows.agg(F.count_if(F.expr("code_likelihood AND said")).alias("hits"), F.count_if(F.expr("code_likelihood AND NOT said")).alias("misses"), F.count_if(F.expr("NOT code_likelihood AND said")).alias("false_alarms"))


_ALL = (
    clean_text, normalize_text, safe_filename, slugify, format_times, looks_like_code, is_code_block, code_line_flags, detect_language, code_regions, region_boxes,
    code_diff_class, code_evolution, code_versions, code_histories, temporal_vote, quality_tokens, quality_report, quality_status_rollup, run_summary, caption_vs_asr_choice, render_srt, render_vtt,
    render_markdown, vtt_cues, vtt_dedup, caption_choice, language_lookup, url_allowlist, watch_url, playlist_range, playlist_index, ocr_best_variant, bbox_union,
    mean_confidence, reading_order, stage_state, resume_anti_join, identity_changed, golden_eval, recognition_speed,
)
QUERIES = {f.__name__: f for f in _ALL}


# -- SQL ------------------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _count(x: str, pattern: str, flags: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(f'(?{flags}){pattern}')}))"


def _light(x: str) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {_q(p)}) AS INT)" for p in fixed.LIGHT_CODE_PATTERNS) + " >= 2)"


def _line(x: str) -> str:
    return f"({x} <> '' AND (" + " OR ".join(f"regexp_matches({x}, {_q('(?i)' + p)})" for p in fixed.LINE_INDICATORS) + "))"


def _block(x: str) -> str:
    hits = " + ".join(f"least({_count(x, p, 'm')}, 5) * CAST({w} AS DOUBLE)" for p, w in fixed.BLOCK_INDICATORS)
    lines = f"string_split({_strip(x)}, chr(10))"
    bonus = f"CASE WHEN len({lines}) >= 3 AND len(list_filter({lines}, lambda l: starts_with(l, '  ') OR starts_with(l, chr(9)))) / len({lines}) > 0.4 THEN 2.0 ELSE 0.0 END"
    return f"({_strip(x)} <> '' AND round({hits} + {bonus}, 6) >= 2.0)"


def _language(x: str) -> tuple[str, str]:
    """(language, score) expressions."""
    scores = {n: " + ".join(f"{_count(x, p, 'im')} * CAST({w} AS DOUBLE)" for p, w in ps) for n, ps in fixed.LANGUAGE_PATTERNS.items()}
    items = ", ".join(f"{{'score': {s}, 'rank': {-i}, 'language': '{n}'}}" for i, (n, s) in enumerate(scores.items()))
    best = f"list_max([{items}])"
    blank = f"{_strip(x)} = ''"
    return f"CASE WHEN {blank} OR {best}.score < {fixed.LANGUAGE_THRESHOLD} THEN 'unknown' ELSE {best}.language END", f"CASE WHEN {blank} THEN 0.0 ELSE {best}.score END"


def _srt(x: str, mark: str) -> str:
    w = f"CAST(floor({x}) AS BIGINT)"
    two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
    return f"({two(f'{w} // 3600')} || ':' || {two(f'{w} // 60 % 60')} || ':' || {two(f'{w} % 60')} || '{mark}' || lpad(CAST(CAST(floor(({x} - floor({x})) * 1000) AS BIGINT) AS VARCHAR), 3, '0'))"


_EV = "WITH ev AS (SELECT DISTINCT event_id AS doc, video_id, timestamp_s, text, code_likelihood FROM ocr_event) "
_VID = "WITH v AS (SELECT DISTINCT * EXCLUDE (generated_at_utc) FROM video_metadata) "
_SEG = "WITH s AS (SELECT DISTINCT transcript_id, segment_id AS seq, start_s AS s0, end_s AS e0, coalesce(text, '') AS text FROM transcript_segment WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND transcript_id IS NOT NULL) "
_REPORT = f"""
WITH s AS (SELECT DISTINCT transcript_id, segment_id, {_strip("coalesce(text, '')")} AS text, quality FROM transcript_segment),
d AS (SELECT transcript_id, max(video_id) AS video_id, max(end_s) - min(start_s) AS duration FROM transcript_segment WHERE transcript_id IS NOT NULL GROUP BY 1),
m AS (SELECT video_id, max(language_probability) AS p FROM video_metadata GROUP BY 1),
w AS (SELECT transcript_id, lower(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS token FROM s),
h AS (SELECT transcript_id, sum(n) AS token_count, count(*) AS distinct_tokens, max(n) AS most FROM (SELECT transcript_id, token, count(*) AS n FROM w GROUP BY ALL) GROUP BY 1),
c AS (SELECT transcript_id, count(*) AS segment_count, count(*) FILTER (text <> '') AS n_texts, sum(length(text)) AS chars, sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS letters,
 sum(length(regexp_replace(text, '\\P{{M}}', '', 'g'))) AS marks, sum(length(regexp_replace(text, '{SPACE}+', '', 'g'))) AS dense,
 avg(quality.avg_logprob) AS lp, avg(quality.no_speech_prob) AS ns, avg(quality.compression_ratio) AS cr FROM s GROUP BY 1),
r AS (SELECT c.transcript_id, segment_count, n_texts, CASE WHEN n_texts > 0 THEN chars + n_texts - 1 ELSE 0 END AS text_chars, coalesce(token_count, 0) AS n, coalesce(distinct_tokens / token_count, 0) AS uniq, coalesce(most / token_count, 0) AS share,
 CASE WHEN dense > 0 THEN (dense - letters - marks) / dense ELSE 1.0 END AS sym, CASE WHEN duration >= 90 THEN coalesce(token_count, 0) / (duration / 60) END AS wpm, lp, ns, cr, p
 FROM c LEFT JOIN h USING (transcript_id) LEFT JOIN d USING (transcript_id) LEFT JOIN m ON m.video_id = d.video_id),
f AS (SELECT *, [CASE WHEN n_texts = 0 OR n = 0 THEN {{'f': 'no_recognizable_text', 'l': 100}} END,
 CASE WHEN n >= 12 AND share >= 0.7 THEN {{'f': 'extreme_token_repetition', 'l': 45}} END,
 CASE WHEN NOT (n >= 12 AND share >= 0.7) AND n >= 30 AND uniq <= 0.12 THEN {{'f': 'low_vocabulary_diversity', 'l': 30}} END,
 CASE WHEN text_chars >= 30 AND sym >= 0.55 THEN {{'f': 'symbol_or_punctuation_heavy', 'l': 35}} END,
 CASE WHEN wpm < 8 THEN {{'f': 'very_low_transcript_density', 'l': 35}} END,
 CASE WHEN wpm >= 8 AND wpm < 15 THEN {{'f': 'low_transcript_density', 'l': 15}} END,
 CASE WHEN lp < -1.0 THEN {{'f': 'low_average_log_probability', 'l': 20}} END,
 CASE WHEN cr > 2.4 THEN {{'f': 'high_compression_ratio', 'l': 20}} END,
 CASE WHEN ns > 0.7 THEN {{'f': 'high_no_speech_probability', 'l': 15}} END,
 CASE WHEN p < 0.5 THEN {{'f': 'uncertain_language_detection', 'l': 15}} END] AS raw FROM r),
g AS (SELECT *, list_filter(raw, lambda x: x IS NOT NULL) AS hit FROM f),
q AS (SELECT transcript_id, segment_count, text_chars, n AS token_count, array_to_string(list_transform(hit, lambda x: x.f), ',') AS flags, CAST(greatest(0, 100 - coalesce(list_sum(list_transform(hit, lambda x: x.l)), 0)) AS INT) AS score,
 CASE WHEN n_texts = 0 OR n = 0 THEN 'failed' WHEN len(hit) = 0 THEN 'passed' ELSE 'review_required' END AS status FROM g)
"""
_LANGS = ", ".join(f"('{a}', {_q(c) if c else 'NULL'})" for a, c in fixed.LANGUAGE_ALIASES.items())
_NAMES = ", ".join(f"('{c}', '{n}')" for c, n in fixed.LANGUAGE_NAMES.items())
_HOSTS = ", ".join(_q(h) for h in fixed.VIDEO_HOSTS)
_STAGE = "[" + ", ".join(_q(s) for s in fixed.STAGES) + "]"
_CUE_TEXT = f"{_strip(f"regexp_replace(regexp_replace(text, '[​﻿]', '', 'g'), '{SPACE}+', ' ', 'g')")}"
_CUES = _SEG.rstrip() + f""", c AS (SELECT transcript_id AS doc, seq, floor(s0 * 1000 + 0) AS x, s0, e0, {_CUE_TEXT} AS text FROM s),
 k AS (SELECT *, {_srt('s0', '.')} AS a, {_srt('e0', '.')} AS b FROM c WHERE text <> '' AND NOT regexp_matches(text, '^\\d+$') AND e0 > s0),
 n AS (SELECT doc, seq, (CAST(substr(a, 1, 2) AS INT) * 3600 + CAST(substr(a, 4, 2) AS INT) * 60) + CAST(substr(a, 7) AS DOUBLE) AS "start", (CAST(substr(b, 1, 2) AS INT) * 3600 + CAST(substr(b, 4, 2) AS INT) * 60) + CAST(substr(b, 7) AS DOUBLE) AS "end", text FROM k),
 p AS (SELECT *, lag(lower(text)) OVER (PARTITION BY doc ORDER BY seq) AS before FROM n WHERE "end" > "start") """
_BOX = "WITH b AS (SELECT DISTINCT event_id AS key, boxes FROM ocr_event WHERE boxes IS NOT NULL) "

#: The rules as (pattern, replacement, what earlier texts must show), with this engine's way of naming groups.
_RULES = [(pattern, new.replace("$", "\\"), voted) for pattern, new, voted in regions.REPAIRS]


def _repaired() -> str:
    out = "text"
    for k, (pattern, new, _) in enumerate(_RULES):
        out = f"CASE WHEN v{k} * 2 > n THEN regexp_replace({out}, {_q('(?m)' + pattern)}, {_q(new)}, 'g') ELSE {out} END"
    return out


_CODE_TEXTS = _EV.rstrip() + ", s AS (SELECT video_id AS video, doc AS seq, timestamp_s AS timestamp, text FROM ev WHERE code_likelihood) "
_ORDERED_BOXES = """
WITH RECURSIVE e AS (SELECT event_id AS key, any_value(boxes) AS boxes FROM ocr_event WHERE boxes IS NOT NULL GROUP BY event_id),
 x AS (SELECT key, unnest(boxes) AS b, generate_subscripts(boxes, 1) - 1 AS pos FROM e),
 o AS (SELECT key, pos, b.x1 AS x1, (b.y1 + b.y2) / 2 AS c, greatest(1, b.y2 - b.y1) AS h, row_number() OVER (PARTITION BY key ORDER BY (b.y1 + b.y2) / 2, b.x1, pos) AS k FROM x WHERE b.x1 + b.y1 + b.x2 + b.y2 IS NOT NULL),
 f(key, k, lines) AS (
  SELECT key, CAST(0 AS BIGINT), CAST([] AS STRUCT(c DOUBLE, h DOUBLE, m STRUCT(x1 INT, pos BIGINT)[])[]) FROM (SELECT DISTINCT key FROM o)
  UNION ALL
  SELECT key, k, CASE WHEN hit IS NULL THEN list_append(lines, {'c': CAST(c AS DOUBLE), 'h': CAST(h AS DOUBLE), 'm': [{'x1': CAST(x1 AS INT), 'pos': pos}]})
    ELSE list_transform(lines, lambda l, i: CASE WHEN i = hit THEN {'c': l.c + c, 'h': l.h + h, 'm': list_append(l.m, {'x1': CAST(x1 AS INT), 'pos': pos})} ELSE l END) END
  FROM (SELECT f.key, o.k, f.lines, o.c, o.h, o.x1, o.pos, list_max(list_filter(range(greatest(1, len(f.lines) - 4), len(f.lines) + 1), lambda i: abs(o.c - f.lines[i].c / len(f.lines[i].m)) <= 0.6 * greatest(o.h, f.lines[i].h / len(f.lines[i].m)))) AS hit
    FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)),
 z AS (SELECT key, arg_max(lines, k) AS lines FROM f GROUP BY key), y AS (SELECT key, unnest(lines) AS l, generate_subscripts(lines, 1) AS n FROM z), w AS (SELECT key, n, unnest(l.m) AS m FROM y)
"""

SQL = {
    "temporal_vote": _CODE_TEXTS + ", p AS (SELECT a.seq, a.text, count(b.seq) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(b.text, {_q('(?m)' + v)})) AS v{k}" for k, (_, _, v) in enumerate(_RULES))
    + " FROM s a LEFT JOIN s b ON a.video = b.video AND b.timestamp >= a.timestamp - 60 AND (b.timestamp < a.timestamp OR b.timestamp = a.timestamp AND b.seq < a.seq) GROUP BY a.seq, a.text) SELECT seq AS doc, CASE WHEN n = 0 THEN text ELSE " + _repaired() + " END AS repaired FROM p",
    "code_versions": _CODE_TEXTS + ", v AS (SELECT *, lag(text) OVER o AS before, lag(timestamp) OVER o AS previous_timestamp FROM s WHERE timestamp IS NOT NULL WINDOW o AS (PARTITION BY video ORDER BY timestamp, seq)) SELECT video, 'main' AS region_key, seq, timestamp, previous_timestamp FROM v WHERE before <> text",
    "reading_order": _ORDERED_BOXES + "SELECT key, row_number() OVER (PARTITION BY key ORDER BY n, m.x1, m.pos) - 1 AS place, m.pos AS box_pos FROM w",
    "region_boxes": _EV + f""", l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM ev),
 i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS island FROM l WHERE {_line('line')}), g AS (SELECT doc, min(pos) AS a, max(pos) AS b FROM i GROUP BY doc, island HAVING count(*) >= 2),
 k AS (SELECT event_id AS doc, any_value(boxes) AS boxes FROM ocr_event GROUP BY 1), u AS (SELECT g.doc, a, boxes[a + 1 : b + 1] AS part FROM g LEFT JOIN k USING (doc))
 SELECT doc, a AS start_line, """ + ", ".join(f"coalesce(list_{f}(list_transform(part, lambda x: coalesce(x.{c}, 0))), 0) AS {c}" for c, f in (("x1", "min"), ("y1", "min"), ("x2", "max"), ("y2", "max"))) + " FROM u",
    "clean_text": f"SELECT doc_id, {_strip("regexp_replace(replace(replace(text, chr(160), ' '), chr(13), ''), '[ \\t]+', ' ', 'g')")} AS cleaned FROM documents",
    "normalize_text": _EV + f"SELECT doc, {sql_norm('text')} AS normalized FROM ev",
    "safe_filename": _VID + f"SELECT DISTINCT video_id, coalesce(nullif(substr({_strip("regexp_replace(regexp_replace(title, '[^A-Za-z0-9._ -]+', '_', 'g'), '\\s+', ' ', 'g')")}, 1, 180), ''), 'video') AS name FROM v",
    "slugify": _VID + f"SELECT DISTINCT video_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower({_strip('title')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70), '^-+|-+$', '', 'g'), ''), 'video') AS slug FROM v",
    "format_times": f"SELECT DISTINCT segment_id AS seq, {sql_time('start_s')} AS plain, {_srt('start_s', ',')} AS srt, {_srt('start_s', '.')} AS vtt FROM transcript_segment WHERE start_s IS NOT NULL",
    "looks_like_code": _EV + f"SELECT doc, {_light('text')} AS is_code FROM ev",
    "is_code_block": _EV + f"SELECT doc, {_block('text')} AS is_code FROM ev",
    "code_line_flags": _EV + f", l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM ev) SELECT doc, pos, {_line('line')} AS is_code FROM l",
    "detect_language": _EV + f"SELECT doc, {_language('text')[0]} AS language, {_language('text')[1]} AS score FROM ev",
    "code_regions": _EV + f""", l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM ev),
 i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS island FROM l WHERE {_line('line')}),
 g AS (SELECT doc, min(pos) AS start_line, max(pos) AS end_line, string_agg(line, chr(10) ORDER BY pos) AS text, bool_or((starts_with(line, '  ') OR starts_with(line, chr(9))) AND {_strip('line')} <> '') AS indented FROM i GROUP BY doc, island HAVING count(*) >= 2)
 SELECT doc, start_line, end_line, text, {_language('text')[0]} AS language, indented FROM g""",
    "quality_tokens": _REPORT + "SELECT * RENAME (most AS most_common) FROM h",
    "quality_report": _REPORT + "SELECT transcript_id, status, score, flags, segment_count, text_chars, token_count FROM q",
    "quality_status_rollup": _REPORT + "SELECT status, count(*) AS n, sum(score) AS points FROM q GROUP BY status",
    "run_summary": _REPORT + """SELECT count(*) AS found, count(*) FILTER (status = 'passed') AS completed, count(*) FILTER (status = 'review_required') AS review, 0 AS skipped, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status IN ('passed', 'review_required')) AS processed, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 1 WHEN count(*) FILTER (status = 'review_required') > 0 THEN 2 ELSE 0 END AS exit_code FROM q""",
    "caption_vs_asr_choice": _REPORT.rstrip() + """, k AS (SELECT video_id, CASE transcription_source WHEN 'caption_manual' THEN 'manual' WHEN 'caption_automatic' THEN 'automatic' ELSE 'asr' END AS kind, max({'score': q.score, 'status': q.status}) AS b FROM q JOIN transcript t USING (transcript_id) GROUP BY ALL),
 j AS (SELECT video_id, kind, b.score AS score, b.status AS status, (kind <> 'asr' AND b.status = 'passed') OR (kind = 'manual' AND b.status = 'review_required') AS wins, max(CASE WHEN kind = 'asr' THEN b.score END) OVER (PARTITION BY video_id) AS asr FROM k),
 o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY wins DESC, CASE WHEN wins THEN CASE kind WHEN 'manual' THEN 0 ELSE 1 END ELSE CASE WHEN kind <> 'asr' AND (asr IS NULL OR score > asr) THEN 0 WHEN kind = 'asr' THEN 1 ELSE 2 END END, score DESC, CASE kind WHEN 'manual' THEN 0 ELSE 1 END) AS n FROM j)
 SELECT video_id, kind, CASE WHEN kind = 'automatic' AND status = 'passed' THEN 'review_required' ELSE status END AS status, score FROM o WHERE n = 1""",
    "render_srt": _SEG + f"SELECT transcript_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {_srt('s0', ',')} || ' --> ' || {_srt('e0', ',')} || chr(10) || {_strip('text')} || chr(10), chr(10) ORDER BY seq) AS document FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seq) AS n FROM s) GROUP BY 1",
    "render_vtt": _SEG + f"SELECT transcript_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_srt('s0', '.')} || ' --> ' || {_srt('e0', '.')} || chr(10) || {_strip('text')} || chr(10), chr(10) ORDER BY seq) AS document FROM s GROUP BY 1",
    "render_markdown": _SEG + f"SELECT transcript_id, '# transcript ' || transcript_id || chr(10) || chr(10) || '## Timestamped transcript' || chr(10) || chr(10) || string_agg('**[' || {sql_time('s0')} || ' – ' || {sql_time('e0')} || ']**' || chr(10) || chr(10) || {_strip('text')} || chr(10), chr(10) ORDER BY seq) AS document FROM s GROUP BY 1",
    "vtt_cues": _CUES + 'SELECT doc, "start", "end", text FROM p WHERE before IS NULL OR before <> lower(text)',
    "vtt_dedup": _CUES + "SELECT doc, count(*) AS n_cues FROM p WHERE before IS NULL OR before <> lower(text) GROUP BY doc",
    "caption_choice": f"""WITH t AS (SELECT DISTINCT video_id AS key, CASE source WHEN 'caption_manual' THEN 'manual' ELSE 'automatic' END AS kind, lang AS track, split_part(replace(lower(lang), '_', '-'), '-', 1) AS family, ends_with(lower(lang), '-orig') AS original
  FROM documents WHERE video_id IS NOT NULL AND lang IS NOT NULL AND source IN ('caption_manual', 'caption_automatic')),
 nm(code, name) AS (VALUES {_NAMES}), d AS (SELECT video_id AS key, split_part(replace(lower(max(detected_language)), '_', '-'), '-', 1) AS declared FROM video_metadata GROUP BY 1),
 g AS (SELECT key, list(DISTINCT family) FILTER (family IN (SELECT code FROM nm)) AS fam, list(DISTINCT family) FILTER (original AND family IN (SELECT code FROM nm)) AS orig FROM t GROUP BY key),
 x AS (SELECT g.key, CASE WHEN len(orig) = 1 THEN orig[1] WHEN len(fam) = 1 THEN fam[1] WHEN list_contains(fam, declared) THEN declared END AS target FROM g LEFT JOIN d USING (key)),
 r AS (SELECT t.*, row_number() OVER (PARTITION BY key ORDER BY kind <> 'manual', NOT original, track) AS n FROM t JOIN x USING (key) WHERE family = target) SELECT key, kind, track FROM r WHERE n = 1""",
    "language_lookup": _VID.rstrip() + f""", a(alias, code) AS (VALUES {_LANGS}), nm(code, name) AS (VALUES {_NAMES})
 SELECT DISTINCT video_id, a.code AS code, CASE WHEN a.code IS NULL THEN 'Undetermined' ELSE coalesce(nm.name, a.code) END AS name, a.alias IS NOT NULL AS known FROM v LEFT JOIN a ON a.alias = lower({_strip('requested_language')}) LEFT JOIN nm ON nm.code = a.code""",
    "url_allowlist": _VID + f"""SELECT DISTINCT video_id, url, coalesce(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) IN ({_HOSTS}), false) AS allowed FROM (SELECT video_id, unnest([url, 'https://www.YouTube.com/watch?v=' || video_id, 'ftp://youtu.be/' || video_id, 'not a url']) AS url FROM v)""",
    "watch_url": _VID + f"SELECT DISTINCT video_id, CASE WHEN length(title) % 2 = 0 AND regexp_matches(url, '^https?://') THEN url ELSE '{fixed.WATCH_URL}' || video_id END AS watch FROM v",
    "playlist_range": _VID + "SELECT video_id, i AS index FROM (SELECT DISTINCT video_id, playlist_index, coalesce(nullif(playlist_index, 0), length(video_id)) AS i FROM v) WHERE i BETWEEN 3 AND 12",
    "playlist_index": _VID + "SELECT DISTINCT playlist_id, video_id, '| ' || coalesce(CAST(playlist_index AS VARCHAR), '') || ' | ' || replace(coalesce(title, 'Untitled'), '|', '\\|') || ' | ' || coalesce(model, 'unknown') || ' | ' || replace(coalesce(detected_language_name, 'Unknown'), '|', '\\|') || ' | — |' AS line FROM v",
    "ocr_best_variant": """WITH p AS (SELECT l_orderkey AS key, l_linenumber AS k, max(l_discount + l_tax) * 5 AS conf, CAST(max(l_quantity) AS INT) AS chars FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
 q AS (SELECT *, conf * ln(1 + greatest(1, chars)) AS quality FROM p),
 w AS (SELECT key, max(CASE WHEN k = 1 THEN conf END) AS conf, max(CASE WHEN k = 1 THEN chars END) AS chars, coalesce(max(CASE WHEN k = 1 THEN quality END), 0) AS q1, max(CASE WHEN k = 2 THEN quality END) AS q2, max(CASE WHEN k = 3 THEN quality END) AS q3, max(CASE WHEN k = 4 THEN quality END) AS q4 FROM q GROUP BY key),
 a AS (SELECT *, CASE WHEN q2 > q1 + 0.02 THEN 'clahe' ELSE 'original' END AS v2, CASE WHEN q2 > q1 + 0.02 THEN q2 ELSE q1 END AS b2 FROM w),
 b AS (SELECT *, CASE WHEN q3 > b2 + 0.02 THEN 'sharpen' ELSE v2 END AS v3, CASE WHEN q3 > b2 + 0.02 THEN q3 ELSE b2 END AS b3 FROM a)
 SELECT key, CASE WHEN chars >= 4 AND conf >= 0.62 THEN 'original' WHEN q4 > b3 + 0.02 THEN 'threshold' ELSE v3 END AS variant FROM b""",
    "bbox_union": _BOX + "SELECT key, min(x.x1) AS x1, min(x.y1) AS y1, max(x.x2) AS x2, max(x.y2) AS y2 FROM (SELECT key, unnest(boxes) AS x FROM b) GROUP BY key",
    "mean_confidence": _BOX + f"SELECT key, CAST(round(coalesce(list_sum(list_transform(boxes, lambda x: coalesce(x.confidence, 0))), 0) * 10000) AS BIGINT) AS sum_confidence, {_strip(f"coalesce(array_to_string(list_filter(list_transform(boxes, lambda x: x.text), lambda t: {_strip("coalesce(t, '')")} <> ''), chr(10)), '')")} AS text FROM b",
    "stage_state": f"""WITH s AS (SELECT l_orderkey AS video, ({_STAGE})[l_linenumber % 5 + 1] AS stage, CASE max(CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 1 END) WHEN 3 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'running' END AS status FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2),
 g AS (SELECT video, stage, k, coalesce(s.status, 'pending') AS status FROM (SELECT DISTINCT o_orderkey AS video, unnest({_STAGE}) AS stage, generate_subscripts({_STAGE}, 1) AS k FROM orders) x LEFT JOIN s USING (video, stage))
 SELECT video, string_agg(stage || '=' || status, ' ' ORDER BY k) AS report, count(*) FILTER (status = 'complete') AS n_complete FROM g GROUP BY video""",
    "resume_anti_join": "SELECT DISTINCT o_orderkey AS video FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 5 AND l_linenumber % 5 = 2 AND l_returnflag = 'N')",
    "identity_changed": "SELECT DISTINCT doc_id AS video FROM documents WHERE doc_id % 7 = 0",
    "recognition_speed": """SELECT model, count(*) AS n, CAST(sum(CAST(round(audio_duration * 1000) AS BIGINT)) AS BIGINT) AS audio_ms, CAST(sum(CAST(round(elapsed_seconds * 1000) AS BIGINT)) AS BIGINT) AS elapsed_ms, count(*) FILTER (elapsed_seconds / audio_duration < 1) AS faster
 FROM (SELECT DISTINCT video_id, model, audio_duration, elapsed_seconds FROM video_metadata WHERE audio_duration > 0 AND elapsed_seconds IS NOT NULL) GROUP BY model""",
    "golden_eval": _EV + f", x AS (SELECT code_likelihood AS c, {_block('text')} AS said FROM ev WHERE code_likelihood IS NOT NULL) SELECT count(*) FILTER (c AND said) AS hits, count(*) FILTER (c AND NOT said) AS misses, count(*) FILTER (NOT c AND said) AS false_alarms FROM x",
}

"""Captions: WebVTT parsing, track choice, playlist entries, renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.fixed import LANGUAGE_ALIASES, LANGUAGE_NAMES
from loomline.functions.text import caption_language_key, format_srt_time, format_time, format_vtt_time, parse_caption_time, strip, strip_cue_markup

from .regions import LINE_BREAKS

_SKIPPED = ("NOTE", "STYLE", "REGION", "Kind:", "Language:")


def parse_vtt(files: DataFrame) -> DataFrame:
    """(doc, index, start, end, text) of the cues of (doc, raw).

    A line with an arrow opens a cue that lasts until the next one. Blank lines, headings, notes and lines of digits alone
    aren't spoken; a line repeated at once within a cue, and a cue that repeats the one before it, count once; cues that
    end before they begin are dropped. All windows are over one file's lines.
    """
    by_doc = Window.partitionBy("doc").orderBy("pos")
    lines = files.select("doc", F.posexplode(F.split(F.regexp_replace("raw", "^﻿", ""), LINE_BREAKS)).alias("pos", "line")).withColumn("line", strip("line"))
    arrow = F.contains("line", F.lit("-->"))
    lines = lines.withColumn("arrow", arrow).withColumn("cue", F.sum(F.col("arrow").cast("int")).over(by_doc)).filter("cue > 0")
    skip = (F.col("line") == "") | (F.col("line") == "WEBVTT") | F.col("line").rlike(r"^\d+$")
    for word in _SKIPPED:
        skip = skip | F.col("line").startswith(word)
    body = F.when(~F.col("arrow") & ~skip, F.struct("pos", strip_cue_markup("line").alias("line")))
    cues = lines.groupBy("doc", "cue").agg(F.max(F.when(F.col("arrow"), F.col("line"))).alias("head"), F.sort_array(F.collect_list(body)).alias("body"))
    left, right = F.split_part("head", F.lit("-->"), F.lit(1)), F.split_part("head", F.lit("-->"), F.lit(2))
    kept = F.filter("body", lambda x: x["line"] != "")
    kept = F.filter(kept, lambda x, i: (i == 0) | (x["line"] != F.get(kept, i - 1)["line"]))
    cues = cues.select(
        "doc", "cue", parse_caption_time(left).alias("start"), parse_caption_time(F.regexp_extract(right, r"^\s*([0-9:.]+)", 1)).alias("end"),
        F.array_join(F.transform(kept, lambda x: x["line"]), " ").alias("text"),
    ).filter("start IS NOT NULL AND end IS NOT NULL AND end > start AND text != ''")
    by_cue = Window.partitionBy("doc").orderBy("cue")
    cues = cues.withColumn("before", F.lag(F.lower("text")).over(by_cue)).filter("before IS NULL OR before != lower(text)")
    return cues.select("doc", (F.row_number().over(by_cue) - 1).alias("index"), "start", "end", "text")


def choose_track(tracks: DataFrame, requested: Column | None = None) -> DataFrame:
    """(key, kind, track): the caption track to use of each key of (key, kind, track, declared), if there is one.

    Without a requested language, it is the only family marked as original, else the only known family, else the declared one if
    it is among the families. Manual tracks come before automatic ones, originals first, then by name.
    """
    family = caption_language_key("track")
    known = F.col("family").isin(*LANGUAGE_NAMES)
    rows = tracks.withColumn("family", family).withColumn("original", F.lower("track").endswith("-orig"))
    per = rows.groupBy("key").agg(F.collect_set(F.when(known, F.col("family"))).alias("families"), F.collect_set(F.when(known & F.col("original"), F.col("family"))).alias("originals"), F.max("declared").alias("declared"))
    declared = caption_language_key("declared")
    auto = F.when(F.size("originals") == 1, F.col("originals")[0]).when(F.size("families") == 1, F.col("families")[0]).when(F.array_contains("families", F.coalesce(declared, F.lit(""))), declared)
    per = per.withColumn("target", auto if requested is None else F.coalesce(requested, auto)).filter(F.col("target").isin(*LANGUAGE_NAMES))
    ranked = F.row_number().over(Window.partitionBy("key").orderBy((F.col("kind") != "manual").cast("int"), (~F.col("original")).cast("int"), "track"))
    return rows.join(per.select("key", "target"), "key").filter("family = target").withColumn("n", ranked).filter("n = 1").select("key", "kind", "track")


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.when(F.coalesce(code, F.lit("")) == "", "Undetermined").otherwise(F.coalesce(F.try_element_at(names, code), code))


def resolve_language(value: Column) -> Column:
    """The code of an alias; null for automatic detection and for unknown aliases (see is_known_alias)."""
    codes = F.create_map(*[F.lit(x) for a, c in LANGUAGE_ALIASES.items() if c for x in (a, c)])
    return F.try_element_at(codes, F.lower(strip(value)))


def is_known_alias(value: Column) -> Column:
    return F.lower(strip(value)).isin(*LANGUAGE_ALIASES)


def playlist_entries(entries: DataFrame, start: int | None = None, end: int | None = None, most: int | None = None) -> DataFrame:
    """Entries of (position, playlist_index, ...) in the inclusive range, the first ``most`` of them; index 0 or null is the position."""
    if (start is not None and start < 1) or (end is not None and start is not None and end < start) or (most is not None and most < 1):
        raise ValueError("playlist range must be positive and ascending")
    index = F.coalesce(F.nullif("playlist_index", F.lit(0)), "position")
    rows = entries.withColumn("original_index", index)
    if start is not None:
        rows = rows.filter(F.col("original_index") >= start)
    if end is not None:
        rows = rows.filter(F.col("original_index") <= end)
    rows = rows.orderBy("original_index", "position")
    return rows.limit(most) if most is not None else rows


def checked_entries(entries: DataFrame, **kw) -> DataFrame:
    """playlist_entries, or an error where none is left."""
    found = playlist_entries(entries.filter("id IS NOT NULL OR title IS NOT NULL OR url IS NOT NULL"), **kw)
    if found.isEmpty():
        raise ValueError("the playlist has no entries in this range")
    return found


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _ordered_text(segments: DataFrame, keys: list[str], piece: Column, joiner: str) -> DataFrame:
    """Pieces joined in order; a document is one transcript, or one part of a recording that with_parts cut."""
    items = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", piece.alias("piece")))).alias("items"))
    return items.select(*keys, F.array_join(F.transform("items", lambda x: x["piece"]), joiner).alias("body"))


def with_parts(rows: DataFrame, time: str, part_s: float = 3600.0) -> DataFrame:
    """With the part of the recording that a row lies in, so that no document grows with the recording."""
    return rows.withColumn("part", F.floor(F.greatest(F.coalesce(time, F.lit(0.0)), F.lit(0.0)) / part_s).cast("int"))


def render_srt(segments: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, document) of (key, seq, start, end, text); numbers count from 1 in each document."""
    keys = _keys(key)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    piece = F.concat(F.col("number").cast("string"), F.lit("\n"), format_srt_time("start"), F.lit(" --> "), format_srt_time("end"), F.lit("\n"), strip("text"), F.lit("\n"))
    return _ordered_text(segments.withColumn("number", number), keys, piece, "\n").withColumnRenamed("body", "document")


def render_vtt(segments: DataFrame, key: str | list[str]) -> DataFrame:
    piece = F.concat(format_vtt_time("start"), F.lit(" --> "), format_vtt_time("end"), F.lit("\n"), strip("text"), F.lit("\n"))
    return _ordered_text(segments, _keys(key), piece, "\n").select(*_keys(key), F.concat(F.lit("WEBVTT\n\n"), "body").alias("document"))


def render_markdown(segments: DataFrame, key: str | list[str], title: Column) -> DataFrame:
    """A heading and each segment under its times."""
    piece = F.concat(F.lit("**["), format_time("start"), F.lit(" – "), format_time("end"), F.lit("]**\n\n"), strip("text"), F.lit("\n"))
    return _ordered_text(segments, _keys(key), piece, "\n").select(*_keys(key), F.concat(F.lit("# "), title, F.lit("\n\n## Timestamped transcript\n\n"), "body").alias("document"))


def render_html(timeline: DataFrame, key: str | list[str] = "video") -> DataFrame:
    """(key, document): a page with one row per event."""
    keys = _keys(key)
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr><td>"), format_time("timestamp"), F.lit("</td><td>"), "type", F.lit("</td><td>"), escape(F.coalesce("text", F.lit(""))), F.lit("</td></tr>"))
    items = timeline.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("timestamp", "rank", "seq", row.alias("row")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["row"]), "\n")
    return items.select(*keys, F.concat(F.lit("<!DOCTYPE html>\n<title>"), escape(F.col(keys[0]).cast("string")), F.lit("</title>\n<table>\n"), body, F.lit("\n</table>\n")).alias("document"))


def playlist_index_lines(records: DataFrame) -> DataFrame:
    """(playlist_id, line, video_id): the table row of each record; pipes in titles and languages are escaped."""
    safe = lambda c, default: F.replace(F.coalesce(c, F.lit(default)), F.lit("|"), F.lit("\\|"))
    link = F.when(F.col("transcript_link").isNull(), "—").otherwise(F.concat(F.lit("[Open]("), "transcript_link", F.lit(")")))
    index = F.coalesce(F.col("playlist_index").cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), index, F.lit(" | "), safe(F.col("title"), "Untitled"), F.lit(" | "), F.coalesce("status", F.lit("unknown")), F.lit(" | "), safe(F.col("language_name"), "Unknown"), F.lit(" | "), link, F.lit(" |"))
    return records.select("playlist_id", line.alias("line"), "video_id")

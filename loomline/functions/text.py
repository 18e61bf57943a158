"""Text and time functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import json
import re
from html import _invalid_charrefs
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import SPACE, VIDEO_HOSTS, WATCH_URL


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes blanks only)."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_time(seconds: Column | str) -> Column:
    """[HH:]MM:SS.mmm, hours only where there are any; seconds are rounded and may show 60.000."""
    s = F.greatest(_col(seconds), F.lit(0.0))
    minutes = F.floor(s / 60)
    ms = F.round((s - minutes * 60) * 1000).cast("long")
    hours = F.floor(minutes / 60)
    tail = F.concat(_two(minutes % 60), F.lit(":"), _two(F.floor(ms / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.when(hours > 0, F.concat(F.when(hours < 10, _two(hours)).otherwise(hours.cast("string")), F.lit(":"), tail)).otherwise(tail)


def _subtitle_time(seconds: Column | str, mark: str) -> Column:
    """HH:MM:SS and milliseconds, cut, not rounded."""
    s = F.greatest(_col(seconds), F.lit(0.0))
    whole = F.floor(s)
    hours = F.floor(whole / 3600)
    ms = F.floor((s - whole) * 1000).cast("string")
    hh = F.when(hours < 100, _two(hours)).otherwise(hours.cast("string"))
    return F.concat(hh, F.lit(":"), _two(F.floor(whole / 60) % 60), F.lit(":"), _two(whole % 60), F.lit(mark), F.lpad(ms, 3, "0"))


def format_srt_time(seconds: Column | str) -> Column:
    return _subtitle_time(seconds, ",")


def format_vtt_time(seconds: Column | str) -> Column:
    return _subtitle_time(seconds, ".")


def parse_caption_time(value: Column | str) -> Column:
    """Seconds of H:M:S or M:S, else null."""
    first = F.regexp_extract(strip(value), r"^(\S*)", 1)
    parts = F.split(first, ":")
    number = lambda i: F.element_at(parts, i).try_cast("double")
    return F.when(F.size(parts) == 3, number(1) * 3600 + number(2) * 60 + number(3)).when(F.size(parts) == 2, number(1) * 60 + number(2))


def clean_text(c: Column | str) -> Column:
    """Hard blanks to blanks, carriage returns out, blanks and tabs collapsed, ends stripped; newlines stay."""
    return strip(F.regexp_replace(F.regexp_replace(F.translate(_col(c), " ", " "), "\r", ""), "[ \t]+", " "))


def safe_filename(name: Column | str) -> Column:
    value = strip(F.regexp_replace(F.regexp_replace(_col(name), "[^A-Za-z0-9._ -]+", "_"), r"\s+", " "))
    return F.coalesce(F.nullif(F.substring(value, 1, 180), F.lit("")), F.lit("video"))


def slugify(value: Column | str, max_length: int = 70) -> Column:
    dashed = F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]+", "-")
    ends = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    return F.coalesce(F.nullif(ends(F.substring(ends(dashed), 1, max_length)), F.lit("")), F.lit("video"))


def slugify_name(value: str | None, max_length: int = 70) -> str:
    """slugify of one string, for names of folders."""
    dashed = re.sub("[^a-z0-9]+", "-", (value or "").strip().lower()).strip("-")
    return dashed[:max_length].strip("-") or "video"


def normalize_screen_text(c: Column | str) -> Column:
    """For comparison only: lower case, plain quotes, single blanks, none around code punctuation."""
    plain = F.translate(F.lower(_col(c)), "“”‘’", "\"\"''")
    single = F.regexp_replace(plain, f"{SPACE}+", " ")
    return strip(F.regexp_replace(single, r"[ \t]*([{}()\[\];,:.=+\-*/<>])[ \t]*", "$1"))


def bigrams(normalized: Column | str) -> Column:
    """The set of character pairs; a text of one character or none is its own only member."""
    n = _col(normalized)
    return F.when(F.length(n) <= 1, F.array(n)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(n) - 1, F.lit(1))), lambda i: F.substr(n, i, F.lit(2)))))


def gram_similarity(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Jaccard of two pair sets: 1 when both texts are empty, 0 when one is."""
    return F.when((text_a == "") & (text_b == ""), F.lit(1.0)).when((text_a == "") | (text_b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bigram_similarity(a: Column | str, b: Column | str) -> Column:
    na, nb = normalize_screen_text(a), normalize_screen_text(b)
    return gram_similarity(bigrams(na), bigrams(nb), na, nb)


def caption_language_key(key: Column | str) -> Column:
    return F.split_part(F.translate(F.lower(_col(key)), "_", "-"), F.lit("-"), F.lit(1))


_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)"


def unescaped(text: Column | str) -> Column:
    """Character references decoded as HTML does: by number, by name, and the old names without their semicolon, the longest first.

    The names are those of Python's html.entities, held once as a constant map.
    """
    # a map is searched from its begin, so names lie in maps by their first letter, and old ones in a small map of their own
    # (a plan prints its constants: the sign stands for the end of a word in the keys, so that plans can be searched for operators of that name)
    by_letter: dict[str, dict[str, str]] = {}
    for known, char in html5.items():
        by_letter.setdefault(known[0], {})[known.replace("rrow", "→")] = char
    names = F.from_json(F.lit(json.dumps(by_letter)), "map<string, map<string, string>>")
    old = F.from_json(F.lit(json.dumps({k: v for k, v in html5.items() if not k.endswith(";")})), "map<string, string>")
    longest = max(len(k) for k in html5 if not k.endswith(";"))
    t = _col(text)
    # what Windows put at the places of control characters, and what stands for no character
    odd = F.from_json(F.lit(json.dumps({str(k): v for k, v in _invalid_charrefs.items()})), "map<string, string>")

    def number(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+)", 1)
        short = F.length(F.regexp_replace(digits, "^0+", "")) <= 8
        code = F.when(short, F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")).otherwise(F.lit(0x110000).cast("bigint"))
        plain = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        control = code.between(1, 8) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | (code == 11) | ((code % 65536).isin(0xFFFE, 0xFFFF) & (code <= 0x10FFFF))
        return F.when(F.map_contains_key(odd, code.cast("string")), F.try_element_at(odd, code.cast("string"))).when(control, F.lit("")).otherwise(plain)

    def name(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2))
        whole = F.try_element_at(F.try_element_at(names, F.substr(body, F.lit(1), F.lit(1))), F.replace(body, F.lit("rrow"), F.lit("→")))
        sizes = F.sequence(F.least(F.length(body), F.lit(longest)), F.lit(1), F.lit(-1))
        fits = F.get(F.filter(sizes, lambda n: F.map_contains_key(old, F.substr(body, F.lit(1), n))), F.lit(0))
        begun = F.transform(F.array(fits), lambda n: F.when(n.isNull(), ref).otherwise(F.concat(F.try_element_at(old, F.substr(body, F.lit(1), n)), F.substr(body, n + 1))))
        return F.coalesce(whole, F.get(begun, F.lit(0)))

    refs = F.regexp_extract_all(t, F.lit(f"({_ENTITY})"), 1)
    parts = F.split(t, _ENTITY)
    decoded = F.transform(refs, lambda r: F.when(r.startswith("&#"), number(r)).otherwise(name(r)))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(decoded, i), F.lit("")))), "")


def strip_cue_markup(line: Column | str) -> Column:
    """A caption line without tags, entities and invisible characters, blanks collapsed."""
    plain = F.regexp_replace(F.regexp_replace(_col(line), r"<\d{1,2}:\d{2}(?::\d{2})?\.\d+>", " "), "<[^>]*>", " ")
    plain = F.when(F.contains(plain, F.lit("&")), unescaped(plain)).otherwise(plain)
    return strip(F.regexp_replace(F.regexp_replace(plain, "[​﻿]", ""), f"{SPACE}+", " "))


def now_iso() -> Column:
    """The time of the query in the session's zone, to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def snippet(text: Column | str, query: str, case_sensitive: bool = False, around: int = 40) -> Column:
    """The match with ``around`` characters on either side; an empty query matches at the begin."""
    t = _col(text)
    at = F.instr(t if case_sensitive else F.lower(t), query if case_sensitive else query.lower()) - 1 if query else F.lit(0)
    begin = F.greatest(at - around, F.lit(0))
    return F.substr(t, begin + 1, F.least(F.length(t), at + len(query) + around) - begin)


def allowed_video_url(url: Column | str) -> Column:
    """Whether an address is http(s) on one of the allowed hosts; false for anything else."""
    u = strip(url)
    return F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https") & F.lower(F.try_parse_url(u, F.lit("HOST"))).isin(*VIDEO_HOSTS), F.lit(False))


def watch_url(url: Column | str, video_id: Column | str) -> Column:
    u = _col(url)
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit(WATCH_URL), F.coalesce(_col(video_id), u)))

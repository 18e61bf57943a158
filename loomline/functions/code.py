"""Code heuristics as sums of regular-expression counts, generated from the fixed pattern tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import BLOCK_INDICATORS, BLOCK_THRESHOLD, LANGUAGE_PATTERNS, LANGUAGE_THRESHOLD, LIGHT_CODE_PATTERNS, LINE_INDICATORS
from .text import strip


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def looks_like_code(text: Column) -> Column:
    return F.coalesce(_sum([text.rlike(p).cast("int") for p in LIGHT_CODE_PATTERNS]) >= 2, F.lit(False))


def is_code_line(line: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [line.rlike(f"(?i){p}") for p in LINE_INDICATORS]) & (line != ""), F.lit(False))


def block_score(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))  # least() would pass over a null count
    hits = _sum([F.least(F.regexp_count(text, F.lit(f"(?dm){p}")), F.lit(5)) * w for p, w in BLOCK_INDICATORS])
    lines = F.split(strip(text), "\n")
    indented = F.size(F.filter(lines, lambda x: x.startswith("  ") | x.startswith("\t"))) / F.size(lines)
    bonus = F.when((F.size(lines) >= 3) & (indented > 0.4), 2.0).otherwise(0.0)
    return F.when(strip(text) == "", 0.0).otherwise(F.round(hits + bonus, 6))


def is_code_block(text: Column) -> Column:
    return F.coalesce(block_score(text) >= BLOCK_THRESHOLD, F.lit(False))


def language_scores(text: Column) -> Column:
    """array<struct<score, rank, language>>; rank is negative, so that the earlier language wins ties."""
    return F.array(
        *[
            F.struct(_sum([F.regexp_count(text, F.lit(f"(?dim){p}")) * w for p, w in patterns]).alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("language"))
            for rank, (name, patterns) in enumerate(LANGUAGE_PATTERNS.items())
        ]
    )


def programming_language(text: Column) -> Column:
    """struct<language, score>: the best-scoring language, unknown below the threshold; blank text is unknown with 0."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    named = lambda best: F.struct(F.when(best["score"] < LANGUAGE_THRESHOLD, "unknown").otherwise(best["language"]).alias("language"), best["score"].alias("score"))
    # a lambda's variable is computed once, however often it is used; the scores are some eighty expressions
    found = F.get(F.transform(F.array(F.array_max(language_scores(text))), named), F.lit(0))
    return F.when(blank, F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("score"))).otherwise(found)

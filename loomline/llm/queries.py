"""Registered pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.fixed import SPACE
from loomline.session import materialize, table

from . import language, leakage, mixing, nearest, repetition, scans, spans


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_in_time(table(spark, d, "ocr_event"), table(spark, d, "transcript_segment")).select("event_id", "segment_id")


def p2_speech_context(spark: SparkSession, d: str) -> DataFrame:
    return nearest.speech_context(table(spark, d, "ocr_event"), table(spark, d, "transcript_segment")).select("event_id", "segment_id", "speech_context")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.stuck_texts(table(spark, d, "transcript"), table(spark, d, "transcript_segment"), lang_sample=table(spark, d, "lang_sample"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "transcript"), table(spark, d, "transcript_segment"), lang_sample=table(spark, d, "lang_sample"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(table(spark, d, "ocr_event"))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.clean_paragraphs(table(spark, d, "ocr_event"))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return language.language_labels(*(table(spark, d, t) for t in ("video_metadata", "transcript_segment", "documents", "lang_sample")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_labels(spark, d).filter("is_wrong").select("item_kind", "item_id", "lang")


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of one language in documents and transcripts."""
    documents = table(spark, d, "documents")
    samples = language.samples_of(table(spark, d, "lang_sample"), documents)
    kinds = (("document", documents, "doc_id"), ("transcript", table(spark, d, "transcript"), "transcript_id"))
    a, b = (language.language_spans(df, samples, key).select(F.lit(kind).alias("item_kind"), "*") for kind, df, key in kinds)
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sizes(table(spark, d, "documents"), table(spark, d, "lang_sample"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.budgeted(_sizes(spark, d), table(spark, d, "mix_target")).filter("stays_under").select("source_name")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(_sizes(spark, d), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    mix = table(spark, d, "mix_target")
    return mixing.actual_shares(mixing.draw(_sizes(spark, d), mix), mix)


def p7_redistribution(spark: SparkSession, d: str) -> DataFrame:
    return mixing.redistribution(materialize(_sizes(spark, d)), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found_pairs(table(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))[0]


def p8_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return spans.fuzzy_passages(table(spark, d, "documents"))


def p8_members(spark: SparkSession, d: str) -> DataFrame:
    return spans.passage_members(table(spark, d, "documents"))


def p8_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


_P2 = """
WITH e AS (SELECT DISTINCT event_id, video_id, timestamp_s AS t FROM ocr_event WHERE timestamp_s IS NOT NULL),
     s AS (SELECT DISTINCT segment_id, video_id, text, start_s AS a, greatest(start_s, coalesce(end_s, start_s)) AS b
           FROM transcript_segment WHERE start_s IS NOT NULL),
     p AS (SELECT e.event_id, s.segment_id, s.text, row_number() OVER (
               PARTITION BY e.event_id ORDER BY greatest(0, a - t, t - b), CASE WHEN a <= t THEN 0 ELSE 1 END, b DESC, a, s.segment_id) AS k
           FROM e JOIN s ON e.video_id = s.video_id AND a <= t + 10 AND b >= t - 10)
"""

_NAMED = (p2_found, p2_speech_context, p3_found, p3_shares, p4_found, p4_paragraphs, p5_found, p5_labels, p5_spans, p6_found, p6_report, p7_found, p7_mix, p7_shares, p7_redistribution, p8_found, p8_passages, p8_fuzzy, p8_members, p8_shared_share)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMED}

_P3 = f"""
WITH t AS (SELECT DISTINCT 'transcript' AS item_kind, transcript_id AS item_id, text FROM transcript WHERE text IS NOT NULL AND transcript_id IS NOT NULL
  UNION SELECT DISTINCT 'segment', segment_id, text FROM transcript_segment WHERE text IS NOT NULL AND segment_id IS NOT NULL),
 l AS (SELECT item_kind, item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}{SPACE[1:-1]}]+', '', 'g'), '{SPACE}+'), lambda w: w <> '') AS words FROM t),
 w AS (SELECT item_kind, item_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l WHERE len(words) >= 8),
 g AS (SELECT item_kind, item_id, n, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o] AS gram FROM w WINDOW o AS (PARTITION BY item_kind, item_id ORDER BY i)),
 f AS (SELECT *, min(i) OVER (PARTITION BY item_kind, item_id, gram) AS first FROM g WHERE i <= n - 3),
 c AS (SELECT DISTINCT item_kind, item_id, n, unnest([i, i + 1, i + 2, i + 3]) AS at FROM f WHERE i > first)
"""

#: Every window of 300 characters of every text.
_P8 = """
WITH d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
 k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies, length(text) AS n_chars, text FROM d WHERE length(text) >= 300),
 w AS (SELECT doc_id, class_id, i, md5(substr(text, CAST(i AS INT), 300)) AS h FROM (SELECT doc_id, class_id, text, unnest(range(1, length(text) - 298)) AS i FROM k)),
 s AS (SELECT DISTINCT h, class_id FROM w), l AS (SELECT DISTINCT a.class_id, b.class_id AS other FROM s a JOIN s b ON a.h = b.h AND a.class_id <> b.class_id)
"""

def _sql_words(x: str) -> str:
    """passage_words, but for compatibility forms of characters."""
    steps = (
        (r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]", ""), (r"(?m)^[> \t]*(?:\d+[ \t]*\n[> \t]*)?\d+:\d\d(?::\d\d)?[.,]\d+[ \t]*-->.*$", ""), (r"(?m)^[ \t]*>+ ?", ""),
        (r"([\p{L}\p{M}])[\x{2010}\x{2011}\x{AC}\x{AD}-][ \t]*\r?\n[ \t>]*(\p{L})", r"\1\2"), (r"\x{AD}", ""),
    )
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


#: Shared shingles of five words as runs on a diagonal, chained in every way that the order and the passage's length allow.
_P6 = f"""
WITH RECURSIVE iw AS (SELECT item_id, {_sql_words('text')} AS w FROM (SELECT DISTINCT item_id, text FROM eval_item WHERE text IS NOT NULL)),
 dw AS (SELECT doc_id, {_sql_words('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
 i5 AS (SELECT item_id, len(w) AS n, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, CAST(unnest(range(1, len(w) - 3)) AS INT) AS i FROM iw)),
 d5 AS (SELECT doc_id, d, array_to_string(w[d : d + 4], ' ') AS s FROM (SELECT doc_id, w, CAST(unnest(range(1, len(w) - 3)) AS INT) AS d FROM dw)),
 m AS (SELECT DISTINCT doc_id, item_id, n, d, i FROM d5 JOIN i5 USING (s)),
 g AS (SELECT *, d - row_number() OVER (PARTITION BY doc_id, item_id, d - i ORDER BY d) AS run FROM m),
 r AS (SELECT doc_id, item_id, n, min(d) AS d, min(i) AS i, count(*) + 4 AS size FROM g GROUP BY doc_id, item_id, n, d - i, run),
 k AS (SELECT *, sum(size) OVER (PARTITION BY doc_id, item_id) AS every FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY d, i) AS no FROM k WHERE 2 * every >= n),
 c(doc_id, item_id, n, no, begin, d_end, i_end, total) AS (
  SELECT doc_id, item_id, n, no, d, d + size, i + size, size FROM q
  UNION
  SELECT c.doc_id, c.item_id, c.n, q.no, c.begin, q.d + q.size, q.i + q.size, c.total + q.size - greatest(0, c.d_end - q.d, c.i_end - q.i)
  FROM c JOIN q ON q.doc_id = c.doc_id AND q.item_id = c.item_id AND q.no > c.no AND q.size - greatest(0, c.d_end - q.d, c.i_end - q.i) >= 5 AND q.d + q.size - c.begin <= 2 * c.n + 5),
 b AS (SELECT doc_id, item_id, max(total) AS covered, max(n) AS n FROM c GROUP BY doc_id, item_id HAVING 2 * max(total) >= max(n))
"""

SQL: dict[str, str] = {
    "p6_found": _P6 + "SELECT doc_id, item_id FROM b",
    "p8_found": _P8 + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p8_shared_share": _P8.rstrip() + """, f AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
 m AS (SELECT DISTINCT class_id, i FROM w SEMI JOIN f USING (h) WHERE doc_id = class_id), g AS (SELECT class_id, i, i - row_number() OVER (PARTITION BY class_id ORDER BY i) AS run FROM m),
 r AS (SELECT class_id, min(i) AS a, max(i) + 300 AS b FROM g GROUP BY class_id, run),
 u AS (SELECT class_id, greatest(a, coalesce(max(b) OVER (PARTITION BY class_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS a, b FROM r),
 c AS (SELECT class_id, sum(greatest(b - a, 0)) AS covered FROM u GROUP BY class_id), n AS (SELECT class_id, count(*) AS n_links FROM l GROUP BY class_id)
 SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(n.n_links, 0) AS n_links, CASE WHEN k.n_copies > 1 THEN k.n_chars ELSE coalesce(c.covered, 0) END::BIGINT AS shared_chars, length(d.text) AS n_chars
 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.class_id = k.class_id LEFT JOIN n ON n.class_id = k.class_id""",
    "p3_found": _P3 + "SELECT item_kind, item_id FROM c GROUP BY item_kind, item_id, n HAVING count(*) * 2 >= n",
    "p2_found": _P2 + "SELECT event_id, segment_id FROM p WHERE k = 1",
    "p7_found": """
WITH d AS (SELECT regexp_replace(lower(trim(source)), '[\\s\\-_]+', '_', 'g') AS s, length(text) AS n FROM documents)
SELECT m.source_name FROM mix_target m LEFT JOIN (SELECT s, sum(n) AS n FROM d GROUP BY s) x ON x.s = m.source_name
WHERE coalesce(x.n, 0) * m.max_repeats < m.target_share * (SELECT sum(n) FROM d)""",
    "p2_speech_context": _P2 + "SELECT event_id, segment_id, text AS speech_context FROM p WHERE k = 1",
}

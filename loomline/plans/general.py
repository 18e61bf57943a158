"""Registered pN_ queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.fixed import SPACE
from loomline.operators import nested
from loomline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_tables(table(spark, d, "raw_record"), keys_only=True)


def p1_children(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_tables(table(spark, d, "raw_record"))


def p1_parents(spark: SparkSession, d: str) -> DataFrame:
    return nested.parent_table(table(spark, d, "raw_record"))


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    return nested.variant_counts(table(spark, d, "raw_record"))


def p1_words(spark: SparkSession, d: str) -> DataFrame:
    return nested.subtype_table(nested.child_tables(table(spark, d, "raw_record")), "word_timed")


def p1_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes given by corners, lists and polygons: three subtype tables with the same columns."""
    children = nested.child_tables(table(spark, d, "raw_record"))
    parts = [nested.subtype_table(children, s).withColumn("subtype", F.lit(s)) for s in ("box_corners", "box_bbox", "box_poly")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every object of any list with its parent's place."""
    return nested.object_table(table(spark, d, "raw_record"), as_json=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_children": p1_children, "p1_parents": p1_parents, "p1_variants": p1_variants, "p1_words": p1_words, "p1_boxes": p1_boxes, "p1_objects": p1_objects}


def _members(x: str) -> str:
    """The members of a JSON list, or of what stands for one, as a list of JSON."""
    inner = f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches(({x})->>'$', '^[\\[{{]') AND json_valid(({x})->>'$') THEN (({x})->>'$')::JSON ELSE {x} END"
    keys = f"json_keys({inner})"
    numbered = f"len({keys}) > 0 AND len(list_filter({keys}, lambda k: NOT regexp_matches(k, '^[0-9]+$'))) = 0"
    return f"""CASE json_type({inner}) WHEN 'ARRAY' THEN CAST({inner} AS JSON[])
  WHEN 'OBJECT' THEN CASE WHEN {numbered} THEN list_transform(list_sort(list_transform({keys}, lambda k: CAST(k AS BIGINT))), lambda k: json_extract({inner}, '$."' || k || '"')) WHEN len({keys}) > 0 THEN [{inner}] ELSE [] END
  WHEN 'VARCHAR' THEN [{inner}] ELSE [] END"""


#: Parents by the label of their list (or the list that the record or its wrapper is), children by the label of theirs.
_P1 = f"""
WITH r AS (SELECT DISTINCT record_id, record_kind, payload::JSON AS j FROM raw_record WHERE payload IS NOT NULL AND json_valid(payload)),
 n AS (SELECT r.record_id, r.record_kind, t.key, t.value, t.id FROM r, json_tree(r.j) t WHERE t.type IN ('ARRAY', 'OBJECT', 'VARCHAR')),
 named AS (SELECT * FROM n WHERE key IN ('segments', 'events', 'ocr_events')),
 lists AS (SELECT * FROM named UNION ALL
  SELECT * FROM n WHERE record_id NOT IN (SELECT record_id FROM named) AND (key IS NULL AND json_type(value) = 'ARRAY' OR key IN ('res', 'result', 'data') AND id < 10 AND json_type(value) <> 'OBJECT')),
 m AS (SELECT record_id, CASE WHEN key = 'segments' THEN 'word' WHEN key IN ('events', 'ocr_events') THEN 'box' WHEN record_kind = 'transcript' THEN 'word' ELSE 'box' END AS child_kind, id, {_members('value')} AS members FROM lists),
 p AS (SELECT record_id, child_kind, parent, row_number() OVER (PARTITION BY record_id ORDER BY id, i) - 1 AS parent_pos FROM (SELECT record_id, child_kind, id, unnest(members) AS parent, generate_subscripts(members, 1) AS i FROM m)),
 q AS (SELECT record_id, child_kind, parent_pos, parent, CASE child_kind WHEN 'word' THEN json_extract(parent, '$.words') ELSE coalesce(nullif(json_extract(parent, '$.boxes'), 'null'::JSON), json_extract(parent, '$.ocr.res.boxes'), json_extract(parent, '$.ocr.boxes'), json_extract(parent, '$.res.boxes')) END AS held FROM p WHERE json_type(parent) = 'OBJECT'),
 h AS (SELECT record_id, child_kind, parent_pos, parent, {_members('held')} AS members FROM q),
 c AS (SELECT record_id, child_kind, parent_pos, parent, unnest(members) AS child, generate_subscripts(members, 1) - 1 AS child_pos FROM h),
 f AS (SELECT *, CASE WHEN json_type(child) = 'VARCHAR' THEN child->>'$' WHEN json_type(child, '$.word') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN child->>'$.word' WHEN json_type(child, '$.text') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN child->>'$.text' END AS text FROM c)
"""

_CHILD = _P1.rstrip() + f", x AS (SELECT * FROM f WHERE regexp_replace(text, '{SPACE}+', '', 'g') <> '')\n"
_SUBTYPE = "CASE WHEN child_kind = 'word' THEN CASE WHEN json_exists(child, '$.start') THEN 'word_timed' ELSE 'word_bare' END WHEN json_type(child, '$.bbox') = 'ARRAY' THEN 'box_bbox' WHEN json_type(child, '$.poly') = 'ARRAY' THEN 'box_poly' WHEN json_exists(child, '$.x1') THEN 'box_corners' ELSE 'box_bare' END"
_VARIANT = "CASE WHEN json_type(child) = 'OBJECT' THEN array_to_string(list_sort(json_keys(child)), ',') ELSE '' END"
_NUMBER = "TRY_CAST(child->>'$.{0}' AS DOUBLE)"

_POINTS = "list_transform(CAST(json_extract(child, '$.poly') AS JSON[]), lambda q: TRY_CAST(q->>'$[{0}]' AS DOUBLE))"
_CORNERS = ", ".join(
    f"CAST(trunc(CASE WHEN child_kind = 'word' THEN NULL WHEN json_type(child, '$.bbox') = 'ARRAY' THEN TRY_CAST(child->>'$.bbox[{i}]' AS DOUBLE) WHEN json_type(child, '$.poly') = 'ARRAY' THEN {'list_min' if i < 2 else 'list_max'}({_POINTS.format(i % 2)}) ELSE TRY_CAST(child->>'$.{k}' AS DOUBLE) END) AS INT) AS {k}"
    for i, k in enumerate(("x1", "y1", "x2", "y2"))
)
_SCORE = "TRY_CAST(CASE WHEN json_exists(child, '$.probability') THEN child->>'$.probability' ELSE child->>'$.confidence' END AS DOUBLE)"

SQL: dict[str, str] = {
    "p1_children": _CHILD + f"SELECT record_id, child_kind, parent_pos, child_pos, {_SUBTYPE} AS subtype, {_VARIANT} AS variant, text, {_NUMBER.format('start')} AS \"start\", {_NUMBER.format('end')} AS \"end\", {_SCORE} AS score, {_CORNERS} FROM x",
    "p1_boxes": _CHILD + f"SELECT record_id, parent_pos, child_pos, {_SUBTYPE} AS subtype, {_VARIANT} AS variant, text, {_SCORE} AS confidence, {_CORNERS} FROM x WHERE {_SUBTYPE} IN ('box_corners', 'box_bbox', 'box_poly')",
    "p1_found": _CHILD + "SELECT DISTINCT record_id, child_kind, parent_pos, child_pos FROM x",
    "p1_words": _CHILD + f"SELECT record_id, parent_pos, child_pos, {_VARIANT} AS variant, text, {_NUMBER.format('start')} AS \"start\", {_NUMBER.format('end')} AS \"end\", {_NUMBER.format('probability')} AS probability FROM x WHERE child_kind = 'word' AND json_exists(child, '$.start')",
    "p1_parents": _P1.rstrip() + """ SELECT record_id, CASE child_kind WHEN 'word' THEN 'segment' ELSE 'event' END AS parent_kind, parent_pos, CASE WHEN json_type(parent) = 'OBJECT' THEN array_to_string(list_sort(json_keys(parent)), ',') ELSE '' END AS variant,
 CASE WHEN json_type(parent, '$.text') = 'VARCHAR' THEN parent->>'$.text' END AS text, TRY_CAST(coalesce(CASE WHEN json_exists(parent, '$.start') THEN parent->>'$.start' ELSE parent->>'$.timestamp' END) AS DOUBLE) AS "start", TRY_CAST(parent->>'$.end' AS DOUBLE) AS "end",
 CAST(TRY_CAST(parent->>'$.frame_index' AS DOUBLE) AS BIGINT) AS frame_index, coalesce(len(h.members), 0) AS n_children FROM p LEFT JOIN (SELECT record_id, parent_pos, members FROM h) h USING (record_id, parent_pos)""",
    "p1_variants": _P1.rstrip() + f" SELECT child_kind, {_SUBTYPE} AS subtype, {_VARIANT} AS variant, count(*) AS n_children, count(DISTINCT record_id) AS n_records FROM f GROUP BY ALL",
}

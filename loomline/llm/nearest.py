"""Pairing records of two tables by nearest time.

Both tables are co-grouped by entity and time range: an event belongs to the one range that holds its time, a
segment to every range that its interval, widened by the tolerance, touches. So each range sees all that can be
nearest, ranges need no further exchange, and one busy entity is spread over as many tasks as it has ranges.
In a range, segments are sorted by start; a binary search over all ranges at once gives each event its two
neighbours: the latest-ending segment that began before it and the next one to begin.

Defined results
  * an event without entity or time, a segment without entity or start: never paired.
  * a segment whose end is missing or before its start is the instant start.
  * NaN and infinite times count as missing.
  * the distance is 0 inside [start, end], else the gap to the nearer end; pairs beyond the tolerance don't come out.
  * ties: an earlier segment (in start, then in id) wins over a later one; among segments that hold the event or
    end before it, the one with the latest end wins.
  * repeated rows of an event or segment give one pair; empty tables give none; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.grouped import map_groups


def _finite(name: str):
    column = F.col(name)
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def nearest_in_time(
    events: DataFrame,
    segments: DataFrame,
    entity: str = "video_id",
    event_id: str = "event_id",
    event_time: str = "timestamp_s",
    segment_id: str = "segment_id",
    start: str = "start_s",
    end: str = "end_s",
    tolerance: float = 10.0,
    range_s: float = 600.0,
    wide_s: float = 7200.0,
) -> DataFrame:
    """(event_id, segment_id, distance): each event with its nearest segment of the same entity within the tolerance.

    Segments longer than ``wide_s`` find their ranges by a join with the entity's events instead of being spread over all of
    them; the result is the same.
    """
    left = (
        events.select(F.col(entity).alias("entity"), F.col(event_id).alias("id"), _finite(event_time).alias("a"))
        .filter("entity IS NOT NULL AND a IS NOT NULL AND id IS NOT NULL")
        .select("entity", F.floor(F.col("a") / range_s).cast("long").alias("slot"), F.lit(False).alias("is_segment"), "id", "a", F.col("a").alias("b"))
    )
    right = (
        segments.select(F.col(entity).alias("entity"), F.col(segment_id).alias("id"), _finite(start).alias("a"), _finite(end).alias("b"))
        .filter("entity IS NOT NULL AND a IS NOT NULL AND id IS NOT NULL")
        .withColumn("b", F.greatest("a", F.coalesce("b", "a")))
    )
    spread = right.withColumns({"first": F.floor((F.col("a") - tolerance) / range_s).cast("long"), "last": F.floor((F.col("b") + tolerance) / range_s).cast("long")})
    is_wide = F.col("b") - F.col("a") > wide_s
    narrow = spread.filter(~is_wide).select("entity", F.explode(F.sequence("first", "last")).alias("slot"), "id", "a", "b")
    # a segment with an absurd end goes only to the ranges where its entity has events
    slots = left.select("entity", "slot").distinct()
    wide = spread.filter(is_wide).join(slots, "entity").filter("slot BETWEEN first AND last").select("entity", "slot", "id", "a", "b")
    right = narrow.unionByName(wide).select("entity", "slot", F.lit(True).alias("is_segment"), "id", "a", "b")

    def pair(table: pa.Table) -> pa.Table | None:
        slot = table.column("slot").to_numpy()
        entity_code = pc.dictionary_encode(table.column("entity").combine_chunks()).indices.to_numpy()
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (entity_code[1:] != entity_code[:-1])
        group = np.cumsum(new) - 1
        is_segment = table.column("is_segment").to_numpy(zero_copy_only=False)
        ids, a, b = (table.column(c).to_numpy() for c in ("id", "a", "b"))
        if is_segment.all() or not is_segment.any():
            return None
        s = np.flatnonzero(is_segment)
        s = s[np.lexsort((ids[s], a[s], group[s]))]
        e = np.flatnonzero(~is_segment)
        e = e[np.lexsort((ids[e], a[e], group[e]))]
        # ranks of (group, time) make one sorted key for all ranges of the batch
        n = len(s)
        order = np.lexsort((np.concatenate([np.zeros(n), np.ones(len(e))]), np.concatenate([a[s], a[e]]), np.concatenate([group[s], group[e]])))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.searchsorted(rank[:n], rank[n:]) - 1
        # per range, the running latest end and where it is
        best = _running_argmax(b[s], group[s])
        before = np.full(len(e), -1)
        ok = (at >= 0) & (group[s][np.maximum(at, 0)] == group[e])
        before[ok] = best[at[ok]]
        after = at + 1
        has_after = (after < n) & (group[s][np.minimum(after, n - 1)] == group[e])
        far = np.inf
        d_before = np.where(before >= 0, np.maximum(a[e] - b[s][before], 0.0), far)
        d_after = np.where(has_after, a[s][np.minimum(after, n - 1)] - a[e], far)
        chosen = np.where(d_before <= d_after, before, np.minimum(after, n - 1))
        distance = np.minimum(d_before, d_after)
        keep = distance <= tolerance
        same = np.zeros(len(e), bool)
        same[1:] = (ids[e][1:] == ids[e][:-1]) & (group[e][1:] == group[e][:-1])
        keep &= ~same
        return pa.table({"event_id": ids[e][keep], "segment_id": ids[s][chosen[keep]], "distance": distance[keep]})

    return map_groups(left.unionByName(right), ["entity", "slot"], pair, "event_id bigint, segment_id bigint, distance double")


def _running_argmax(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the largest value so far within each run of equal group; the first of equals."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    # equal values share the rank of the first one
    sorted_values = values[order]
    level = np.concatenate([[0], np.cumsum(sorted_values[1:] != sorted_values[:-1])])
    rank[order] = level
    offset = group.astype(np.int64) * (int(level[-1]) + 1)
    running = np.maximum.accumulate(rank + offset)
    at = np.arange(n)
    is_new = np.ones(n, bool)
    is_new[1:] = running[1:] != running[:-1]
    return np.maximum.accumulate(np.where(is_new, at, 0))


def speech_context(events: DataFrame, segments: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """The text of the nearest segment for each event that has one: what speech_context should hold."""
    pairs = nearest_in_time(events, segments, tolerance=tolerance)
    texts = segments.select("segment_id", "text").dropDuplicates(["segment_id"])
    return pairs.join(texts, "segment_id").select("event_id", "segment_id", "distance", F.col("text").alias("speech_context"))

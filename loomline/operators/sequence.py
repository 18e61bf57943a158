"""Ordered-stream operators: previous row across slices, scenes, keep-last deduplication, adaptive sampling.

A window over one entity runs in one task however busy the entity is. ``previous`` therefore orders within time
slices and carries each slice's last row to the next slice that has any, so a hot entity is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import bigrams, gram_similarity, normalize_screen_text
from loomline.operators.grouped import map_groups
from loomline.session import materialize


def previous(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], slice_of: Column, prefix: str = "prev_") -> DataFrame:
    """``df`` with prev_<column> of the row before in ``order`` within ``entity``; null for the first.

    ``slice_of`` must not fall along the order. Only one row per slice takes part in the second, entity-wide window.
    """
    rows = df.withColumn("_slice", slice_of)
    key = F.struct(*order)
    last = rows.groupBy(entity, "_slice").agg(F.max_by(F.struct(*columns), key).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(entity).orderBy("_slice"))).drop("_last")
    inside = Window.partitionBy(entity, "_slice").orderBy(*order)
    rows = rows.withColumn("_here", F.lag(F.struct(*columns)).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    joined = rows.join(carried, [entity, "_slice"], "left")
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_here"))
    return joined.withColumns({f"{prefix}{c}": before[c] for c in columns}).drop("_slice", "_here", "_first", "_carry")


def signature_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two signatures; 1 where either is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(total / F.size(a), F.lit(1.0))


def scene_changes(frames: DataFrame, threshold: float = 0.15, frames_per_slice: int = 5000) -> DataFrame:
    """(video, seq, timestamp, difference) of frames that differ from the one before by the threshold; a first frame always does."""
    with_before = previous(frames, "video", ["seq"], ["signature"], F.floor(F.col("seq") / frames_per_slice))
    difference = signature_difference(F.col("signature"), F.col("prev_signature"))
    return with_before.withColumn("difference", difference).filter(F.col("difference") >= threshold).select("video", "seq", "timestamp", "difference")


def dark_frames_removed(frames: DataFrame, min_luma: float = 8.0, scene_threshold: float = 0.065) -> DataFrame:
    """Without frames that are dark and hardly changed (luma, difference)."""
    return frames.filter(~((F.col("luma") < min_luma) & (F.col("difference") < scene_threshold * 1.5)))


def after_mark(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows later than their video's high-water mark (video, mark); all rows of a video without one."""
    return rows.join(marks, "video", "left").filter("mark IS NULL OR timestamp > mark").drop("mark")


def keep_changed(observations: DataFrame, similarity: float = 0.965, heartbeat: float = 3.0, min_chars: int = 4, slice_s: float = 600.0) -> DataFrame:
    """(video, seq, timestamp) of the observations kept: unlike the last kept one, or ``heartbeat`` seconds after it.

    Similarity isn't transitive, so the comparison is with the last kept row, and a window function can't give it. But what a time
    slice keeps depends on all before it through one row only: the last one kept, which lies less than ``heartbeat`` before the
    slice's first row, or else that row is kept whatever came before. So every slice of a video is decided on its own, for each row
    that could be the last kept one before it (their ways soon meet); then the slices' few possible states are chained in order,
    and each slice's rows are those of the state that came true.
    """
    if slice_s < heartbeat:
        raise ValueError("a slice must be as long as the heartbeat")
    norm = normalize_screen_text(F.coalesce("text", F.lit("")))
    rows = observations.filter((F.length(F.trim(F.coalesce("text", F.lit("")))) >= min_chars) & F.col("timestamp").isNotNull()).select("video", F.col("seq").cast("long"), F.col("timestamp").cast("double"), norm.alias("norm"))
    own = F.floor(F.col("timestamp") / slice_s)
    # a row at the end of a slice is seen by the next one too
    ends = F.col("timestamp") > (own + 1) * slice_s - heartbeat
    rows = rows.withColumn("own", own).withColumn("slice", F.explode(F.when(ends, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    rows = rows.select("video", "slice", "timestamp", "seq", "norm", (F.col("own") == F.col("slice")).alias("is_own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64())
        for batch in batches:
            out: list[tuple] = []
            for video, slice_, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (video, slice_) != now:
                    if held:
                        out += [(*now, *x) for x in slice_ways(held, similarity, heartbeat)]
                    now, held = (video, slice_), []
                held.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=WAYS)
        if held and (out := [(*now, *x) for x in slice_ways(held, similarity, heartbeat)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=WAYS)

    sorted_rows = rows.repartition("video", "slice").sortWithinPartitions("video", "slice", "timestamp", "seq")
    ways = materialize(sorted_rows.mapInArrow(run, "video string, slice bigint, way int, part string, seq bigint, timestamp double"))
    taken = map_groups(ways.filter("part != 'keep'"), ["video"], chained_ways, "video string, slice bigint, taken int", order=["slice"])
    kept = ways.filter("part = 'keep'").join(taken, [ways["video"].eqNullSafe(taken["video"]), ways["slice"] == taken["slice"]])
    return kept.filter("way = taken OR way = -2").select(ways["video"], "seq", "timestamp")


WAYS = ["video", "slice", "way", "part", "seq", "timestamp"]


def slice_ways(rows: list[tuple[float, int, str, bool]], similarity: float, heartbeat: float) -> Iterator[tuple[int, str, int | None, float | None]]:
    """(way, part, seq, timestamp) of one slice's ordered rows (timestamp, seq, text, is_own).

    A way is what happens after one possible last kept row: 'in' names that row (way -1 has none), 'keep' the rows it keeps (way -2
    stands for all ways), and 'out' the last kept row at the slice's end.
    """
    own = [r for r in rows if r[3]]
    if not own:
        return
    before = [r for r in rows if not r[3] and own[0][0] - r[0] < heartbeat]
    yield -1, "in", None, None
    for way, (at, seq, _, _) in enumerate(before):
        yield way, "in", seq, at
    # ways whose last kept row is the same are one from there on
    last: dict[tuple | None, list[int]] = {None: [-1], **{r: [way] for way, r in enumerate(before)}}
    for row in own:
        keepers = [r for r in last if r is None or row[0] - r[0] >= heartbeat or similarity_of(r[2], row[2]) < similarity]
        if keepers:
            ways = [w for r in keepers for w in last.pop(r)]
            for way in ways if last else (-2,):
                yield way, "keep", row[1], row[0]
            last[row] = ways
    for row, ways in last.items():
        for way in ways:
            yield way, "out", row[1] if row else None, row[0] if row else None


def chained_ways(ways: pa.Table) -> pa.Table:
    """(video, slice, taken): the way that each slice takes, for whole videos with their slices in order."""
    out: list[tuple] = []
    state = None
    entries: dict[tuple | None, int] = {}
    ends: dict[int, tuple] = {}
    now = None

    def close(state: tuple | None) -> tuple | None:
        way = entries.get(state, -1)
        out.append((*now, way))
        return ends.get(way)

    for v, slice_, way, part, seq, at in zip(*(ways.column(c).to_pylist() for c in WAYS)):
        if (v, slice_) != now:
            if now is not None:
                state = close(state)
            if now is None or v != now[0]:
                state = None
            now, entries, ends = (v, slice_), {}, {}
        if part == "in":
            entries[(seq, at) if seq is not None else None] = way
        else:
            ends[way] = (seq, at)
    if now is not None:
        close(state)
    return pa.table({"video": pa.array([o[0] for o in out], pa.string()), "slice": pa.array([o[1] for o in out], pa.int64()), "taken": pa.array([o[2] for o in out], pa.int32())})


def similarity_of(a: str, b: str) -> float:
    """Jaccard of character pairs of two normalised texts: 1 when both are empty, 0 when one is."""
    if a == b or not a or not b:
        return 1.0 if a == b else 0.0
    ga, gb = ({x[i : i + 2] for i in range(len(x) - 1)} or {x} for x in (a, b))
    return len(ga & gb) / len(ga | gb)


class Keeper:
    """The last kept text of a stream and when it was kept."""

    __slots__ = ("at", "text", "similarity", "heartbeat")

    def __init__(self, similarity: float, heartbeat: float, at: float | None = None, text: str | None = None) -> None:
        self.similarity, self.heartbeat, self.at, self.text = similarity, heartbeat, at, text

    def offer(self, at: float, text: str) -> bool:
        """Whether this text is kept."""
        if self.at is None or at - self.at >= self.heartbeat or similarity_of(self.text, text) < self.similarity:
            self.at, self.text = at, text
            return True
        return False


def consecutive_similarity(observations: DataFrame, slice_s: float = 600.0) -> DataFrame:
    """(video, seq, similarity) of each observation with the one before it."""
    rows = observations.select("video", "seq", "timestamp", normalize_screen_text(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = previous(rows, "video", ["timestamp", "seq"], ["norm"], F.floor(F.col("timestamp") / slice_s)).filter("prev_norm IS NOT NULL")
    return rows.select("video", "seq", gram_similarity(bigrams("prev_norm"), bigrams("norm"), F.col("prev_norm"), F.col("norm")).alias("similarity"))


class Sampler:
    """State of one video's adaptive sampler: when the next sample is due, until when it is active, what it saw last."""

    __slots__ = ("next_at", "active_until", "last", "normal", "active", "window", "threshold")

    def __init__(self, normal: float, active: float, window: float, threshold: float) -> None:
        self.normal, self.active, self.window, self.threshold = normal, active, window, threshold
        self.next_at, self.active_until, self.last = 0.0, -1.0, None

    def offer(self, at: float, value) -> float | None:
        """The difference to the last sample if this frame is sampled, else None; a value is a number or a signature."""
        if at + 0.01 < self.next_at:
            return None
        difference = 1.0 if self.last is None else float(np.abs(np.subtract(value, self.last)).mean()) if isinstance(value, np.ndarray) else abs(value - self.last)
        if difference >= self.threshold:
            self.active_until = max(self.active_until, at + self.window)
        self.last = value
        self.next_at = at + (self.active if at < self.active_until else self.normal)
        return difference


def adaptive_sample(frames: DataFrame, normal: float = 2.0, active: float = 0.5, window: float = 8.0, threshold: float = 0.065) -> DataFrame:
    """(video, seq, timestamp, difference) of the sampled frames of (video, seq, timestamp, value), value a number or a signature.

    With a column ``duration``, a video's sampling ends with the first sample at or after it.
    Which frames are compared depends on all before, so a video is one ordered stream; rows pass through a worker
    batch by batch and only the sampler's state is held, however long the video.
    """

    is_signature = dict(frames.dtypes)["value"].startswith("array")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state, over = object(), None, False
        for batch in batches:
            out: list[tuple] = []
            values = batch.column(3)
            for i, (v, seq, at, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
                if state is None or v != video:
                    video, state, over = v, Sampler(normal, active, window, threshold), False
                if over:
                    continue
                value = values[i].values.to_numpy(zero_copy_only=False).astype(np.float64) if is_signature else values[i].as_py()
                if (difference := state.offer(at, value)) is not None:
                    out.append((v, seq, at, difference))
                    over = end is not None and at >= end
            if out:
                types = (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["video", "seq", "timestamp", "difference"])

    kind = dict(frames.dtypes)["video"]
    end = F.col("duration").cast("double") if "duration" in frames.columns else F.lit(None).cast("double")
    value = F.col("value") if is_signature else F.col("value").cast("double")
    rows = frames.select("video", F.col("seq").cast("long"), F.col("timestamp").cast("double"), value, end.alias("end")).filter("timestamp IS NOT NULL AND value IS NOT NULL")
    return rows.repartition("video").sortWithinPartitions("video", "timestamp", "seq").mapInArrow(run, f"video {kind}, seq bigint, timestamp double, difference double")

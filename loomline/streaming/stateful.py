"""Streaming forms of the stateful operators: the same step functions, with state kept per video between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.functions.text import normalize_screen_text
from loomline.operators.sequence import Keeper, Sampler


def keep_changed_stream(observations: DataFrame, threshold: float = 0.965, heartbeat: float = 3.0, min_chars: int = 4) -> DataFrame:
    """(video, seq, timestamp) kept of a stream of (video, seq, timestamp, text).

    Rows of a batch are ordered by time within a video; the state is the last kept row. A row that comes later than a newer one
    in an earlier batch is judged against what was kept then. Null times and texts of fewer than min_chars are dropped; a row
    repeated within a batch counts once.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keeper = Keeper(threshold, heartbeat, *(state.get if state.exists else (None, None)))
        rows = pd.concat(list(parts)).sort_values(["timestamp", "seq"], kind="stable").drop_duplicates(["timestamp", "seq"])
        kept = [(key[0], seq, at) for seq, at, norm in zip(rows["seq"], rows["timestamp"], rows["norm"]) if keeper.offer(float(at), norm)]
        state.update((keeper.at, keeper.text))
        yield pd.DataFrame(kept, columns=["video", "seq", "timestamp"])

    rows = observations.filter((F.length(F.trim(F.coalesce("text", F.lit("")))) >= min_chars) & F.col("timestamp").isNotNull())
    rows = rows.select("video", F.col("seq").cast("long"), "timestamp", normalize_screen_text(F.coalesce("text", F.lit(""))).alias("norm"))
    return rows.groupBy("video").applyInPandasWithState(step, "video string, seq bigint, timestamp double", "at double, text string", "append", GroupStateTimeout.NoTimeout)


def adaptive_sample_stream(frames: DataFrame, normal: float = 2.0, active: float = 0.5, window: float = 8.0, threshold: float = 0.065) -> DataFrame:
    """(video, seq, timestamp, difference) sampled of a stream of (video, seq, timestamp, value)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sampler = Sampler(normal, active, window, threshold)
        if state.exists:
            sampler.next_at, sampler.active_until, sampler.last = state.get
        rows = pd.concat(list(parts)).sort_values(["timestamp", "seq"], kind="stable")
        taken = [(key[0], seq, at, d) for seq, at, value in zip(rows["seq"], rows["timestamp"], rows["value"]) if (d := sampler.offer(float(at), float(value))) is not None]
        state.update((sampler.next_at, sampler.active_until, sampler.last))
        yield pd.DataFrame(taken, columns=["video", "seq", "timestamp", "difference"])

    rows = frames.filter("timestamp IS NOT NULL AND value IS NOT NULL").select("video", F.col("seq").cast("long"), "timestamp", "value")
    return rows.groupBy("video").applyInPandasWithState(step, "video string, seq bigint, timestamp double, difference double", "next_at double, active_until double, last double", "append", GroupStateTimeout.NoTimeout)


def activity_episodes(changes: DataFrame, time_column: str, gap: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of changes that follow each other within ``gap``; rows later than the watermark are dropped by definition."""
    window = F.session_window(time_column, gap)
    return changes.withWatermark(time_column, late).groupBy("video", window.alias("episode")).agg(F.count("*").alias("n_changes")).select("video", F.col("episode.start").alias("start"), F.col("episode.end").alias("end"), "n_changes")

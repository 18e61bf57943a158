"""Matching golden annotations with what was found: nearest in time within a type, with character error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(annotations: DataFrame, found: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(video, seq, match, time_error, edits, char_error_rate): each annotation (video, seq, timestamp, type, text) with the nearest
    found event of its video and type, nulls where none is within the tolerance.

    The join is on time ranges as long as the tolerance and their two neighbours; ties go to the smaller seq. The rate is edits by the annotation's
    length, null for an empty annotation.
    """
    slot = F.floor(F.col("timestamp") / tolerance)
    a = annotations.select("video", "type", "seq", F.col("timestamp").alias("at"), F.coalesce("text", F.lit("")).alias("wanted"), slot.alias("slot"))
    f = found.select("video", "type", F.col("seq").alias("match"), F.col("timestamp").alias("then"), F.coalesce("text", F.lit("")).alias("got"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    near = a.join(f, ["video", "type", "slot"], "left").withColumn("time_error", F.abs(F.col("then") - F.col("at")))
    near = near.withColumn("pair", F.when(F.col("time_error") <= tolerance, F.struct("time_error", "match", "got")))
    # the least struct is the nearest; comparing needs no window over a busy video
    best = near.groupBy("video", "seq").agg(F.min("pair").alias("pair"), F.first("wanted").alias("wanted"))
    edits = F.levenshtein(F.col("pair.got"), F.col("wanted"))
    return best.select("video", "seq", "pair.match", "pair.time_error", edits.alias("edits"), F.try_divide(edits, F.length("wanted")).alias("char_error_rate"))


def scores(matches: DataFrame, found: DataFrame) -> DataFrame:
    """One row: recall, precision (found events that an annotation took), mean time error and mean character error rate."""
    n = found.agg(F.count("*").alias("n_found"))
    sums = matches.agg(F.count("*").alias("n_wanted"), F.count("match").alias("n_matched"), F.countDistinct("match").alias("n_used"), F.avg("time_error").alias("time_error"), F.avg("char_error_rate").alias("char_error_rate"))
    return sums.join(F.broadcast(n)).select(F.try_divide("n_matched", "n_wanted").alias("recall"), F.try_divide("n_used", "n_found").alias("precision"), "time_error", "char_error_rate")

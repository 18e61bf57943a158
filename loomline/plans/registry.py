"""All core queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.operators import fusion, search
from loomline.plans import files, general, pieces, streams, text, timeline

_MODULES = (general, timeline, text, streams, files, pieces)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The fused timeline, each screen event with the speech around it, searched for a word."""
    fused = timeline.timeline(spark, d)
    context = timeline.speech_context_bucketed(spark, d)
    found = search.search(fused, "between")
    return found.join(context, ["video", "seq"], "left").orderBy("video", "timestamp", "seq")

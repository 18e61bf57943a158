"""Code on screen: regions of code lines, version chains with diffs, repair by temporal vote."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.code import is_code_line, programming_language
from loomline.functions.text import format_time, strip

from .sequence import previous

LINE_BREAKS = "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}\\x{1D}\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


def code_regions(texts: DataFrame, min_lines: int = 2) -> DataFrame:
    """(doc, start_line, end_line, text, language, confidence, indented) of each run of ``min_lines`` or more code lines of (doc, text).

    Gaps and islands over one text's lines; a blank line ends a run.
    """
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(is_code_line(F.col("line")))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    runs = lines.withColumn("island", island).groupBy("doc", "island").agg(F.min("pos").alias("start_line"), F.max("pos").alias("end_line"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    runs = runs.filter(F.col("end_line") - F.col("start_line") + 1 >= min_lines).withColumn("text", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    indented = F.exists("lines", lambda x: (x["line"].startswith("  ") | x["line"].startswith("\t")) & (strip(x["line"]) != ""))
    best = programming_language(F.col("text"))
    return runs.withColumn("best", best).select("doc", "start_line", "end_line", "text", F.col("best.language").alias("language"), F.least(F.lit(1.0), F.col("best.score") / 10).alias("confidence"), indented.alias("indented"))


def region_boxes(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Regions with the union rectangle of the boxes (doc, boxes) at their lines; zeros where there are none."""
    part = F.when(F.col("start_line") < F.size("boxes"), F.slice("boxes", F.col("start_line") + 1, F.col("end_line") - F.col("start_line") + 1))
    with_part = regions.join(boxes.select("doc", "boxes"), "doc", "left").withColumn("part", F.coalesce(part, F.expr("slice(boxes, 1, 0)")))
    side = lambda f, k: F.coalesce(f(F.transform("part", lambda b: F.coalesce(b[k], F.lit(0)))), F.lit(0)).alias(k)
    return with_part.select(*regions.columns, side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2"))


def changed_lines(before: str, after: str) -> tuple[list[str], list[str]]:
    """(added, removed) lines in order. Lines whose content begins with ++ or -- look like a diff's header and don't count."""
    diff = list(difflib.unified_diff(before.splitlines(), after.splitlines(), lineterm=""))
    added = [x[1:] for x in diff if x[:1] == "+" and x[:3] != "+++"]
    return added, [x[1:] for x in diff if x[:1] == "-" and x[:3] != "---"]


def change_class(n_added: Column, n_removed: Column) -> Column:
    return F.when((n_removed == 0) | (n_added > n_removed * 2), "addition").when((n_added == 0) | (n_removed > n_added * 2), "deletion").otherwise("modification")


def differing(snapshots: DataFrame, slice_s: float = 600.0) -> DataFrame:
    """(video, region_key, seq, timestamp, previous_timestamp, prev_text, text) of the snapshots (video, seq, timestamp, text) that differ
    from the one before of the same video and region; rows without a column ``region_key`` are of one region, 'main'.

    A snapshot equal to the one before is equal to the last accepted one, so the row before is enough. Snapshots without a text or
    time are no versions.
    """
    timed = snapshots.filter("text IS NOT NULL AND timestamp IS NOT NULL")
    timed = timed.withColumn("region_key", F.coalesce("region_key", F.lit("main")) if "region_key" in snapshots.columns else F.lit("main"))
    timed = timed.withColumn("_of", F.struct("video", "region_key"))
    rows = previous(timed, "_of", ["timestamp", "seq"], ["text", "timestamp"], F.floor(F.col("timestamp") / slice_s))
    return rows.filter("prev_text IS NOT NULL AND prev_text != text").select("video", "region_key", "seq", "timestamp", F.col("prev_timestamp").alias("previous_timestamp"), "prev_text", "text")


def version_chain(snapshots: DataFrame, slice_s: float = 600.0) -> DataFrame:
    """(video, region_key, seq, timestamp, previous_timestamp, added, removed, change) of the versions that ``differing`` finds: only
    texts that differ reach the diff."""
    differ = differing(snapshots, slice_s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [changed_lines(a, b) for a, b in zip(batch.column("prev_text").to_pylist(), batch.column("text").to_pylist())]
            lists = pa.list_(pa.string())
            columns = [batch.column(c) for c in ("video", "region_key", "seq", "timestamp", "previous_timestamp")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a for a, _ in both], lists), pa.array([r for _, r in both], lists)], names=["video", "region_key", "seq", "timestamp", "previous_timestamp", "added", "removed"])

    diffs = differ.mapInArrow(run, "video string, region_key string, seq bigint, timestamp double, previous_timestamp double, added array<string>, removed array<string>")
    return diffs.filter((F.size("added") > 0) | (F.size("removed") > 0)).withColumn("change", change_class(F.size("added"), F.size("removed")))


def evolution_lines(chain: DataFrame) -> DataFrame:
    """(video, region_key, seq, line): each change as a line of a readable history."""
    return chain.select("video", "region_key", "seq", F.concat(F.lit("── t="), format_time("timestamp"), F.lit(" ──  ↓ "), "change", F.lit(" (+"), F.size("added"), F.lit(" -"), F.size("removed"), F.lit(")")).alias("line"))


#: Fixed repair rules: what a cut line looks like, what it becomes, and what earlier texts must show.
REPAIRS = (
    (r"for\s+(\w+)\s+in\s+range\((\w+)\s*$", "for $1 in range($2):", r"for \w+ in range\([^)]*\):"),
    (r"\bif\s+(\w+)\s*$", "if $1:", r"if \w+:"),
    (r"\belse\s*$", "else:", r"else:"),
    (r"\bdef\s+(\w+)\s*\(([^)]*)\)\s*$", "def $1($2):", r"def \w+\([^)]*\):"),
)


def evolutions(snapshots: DataFrame) -> DataFrame:
    """(video, region_key, n_versions, n_changes, first_seen, last_seen, history): all versions of each region, as one row."""
    chain = version_chain(snapshots)
    keyed = snapshots.filter("text IS NOT NULL AND timestamp IS NOT NULL").withColumn("region_key", F.coalesce("region_key", F.lit("main")) if "region_key" in snapshots.columns else F.lit("main"))
    seen = keyed.groupBy("video", "region_key").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    lines = evolution_lines(chain).groupBy("video", "region_key").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    times = chain.groupBy("video", "region_key").agg(F.count("*").alias("n_changes"))
    found = seen.join(times, ["video", "region_key"], "left").join(lines, ["video", "region_key"], "left")
    history = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    changes = F.coalesce("n_changes", F.lit(0))
    return found.select("video", "region_key", (changes + 1).alias("n_versions"), changes.alias("n_changes"), "first_seen", "last_seen", F.coalesce(history, F.lit("")).alias("history"))


def with_earlier(snapshots: DataFrame, within_s: float = 60.0) -> DataFrame:
    """(video, seq, timestamp, text, earlier): with the texts of the same video that stand before (timestamp, seq) and at most
    ``within_s`` seconds back, in order. Rows without a video, time or text are no one's earlier text and have none.

    A row also goes to the time slice after its own, so a task sees two slices of a video and never all of it.
    """
    is_timed = F.col("video").isNotNull() & F.col("timestamp").isNotNull() & ~F.isnan(F.col("timestamp").cast("double")) & F.col("text").isNotNull()
    own = F.floor(F.col("timestamp") / within_s)
    sliced = snapshots.filter(is_timed).withColumn("own", own).withColumn("slice", F.explode(F.array("own", F.col("own") + 1)))
    near = Window.partitionBy("video", "slice").orderBy(F.floor("timestamp")).rangeBetween(-int(within_s) - 1, 0)  # whole seconds; cut exactly below
    seen = sliced.withColumn("near", F.sort_array(F.collect_list(F.struct("timestamp", "seq", "text")).over(near))).filter("slice = own")
    before = lambda x: (x["timestamp"] >= F.col("timestamp") - within_s) & ((x["timestamp"] < F.col("timestamp")) | ((x["timestamp"] == F.col("timestamp")) & (x["seq"] < F.col("seq"))))
    timed = seen.select("video", "seq", "timestamp", "text", F.transform(F.filter("near", before), lambda x: x["text"]).alias("earlier"))
    rest = snapshots.filter(~F.coalesce(is_timed, F.lit(False))).select("video", "seq", "timestamp", "text", F.expr("cast(array() as array<string>)").alias("earlier"))
    return timed.unionByName(rest)


def repair_by_vote(text: Column, earlier: Column) -> Column:
    """A rule applies where more than half of the earlier texts show its repaired form."""

    def apply(current: Column, rule: tuple[str, str, str]) -> Column:
        pattern, replacement, voted = rule
        votes = F.size(F.filter(earlier, lambda p: p.rlike(f"(?m){voted}")))
        return F.when(votes * 2 > F.size(earlier), F.regexp_replace(current, f"(?dm){pattern}", replacement)).otherwise(current)

    return F.when(F.size(earlier) == 0, text).otherwise(reduce(apply, REPAIRS, text))

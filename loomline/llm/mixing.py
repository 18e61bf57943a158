"""Mixing sources to target weights (hierarchical budgeting).

The target shares sit on the sources of a domain - language - source tree. A leaf is one source in one language; a source's
share is divided over its languages by size. A leaf can supply its tokens at most max_repeats times. What a
leaf can't supply is redistributed by weight among its siblings under the same parent first, and only what they
can't take rises to the parent's siblings, up to the root. Each leaf's budget is then filled from seeded epochs: the leaf's
records in an order drawn from (seed, epoch, id), whole epochs first, then the token-prefix of the last one.

Sizes are tokens of a public tokenizer whose vocabulary file is a parameter; it is never copied or trained.

Defined results
  * source names are compared lower-case, trimmed, with blanks and hyphens as underscores. Records without a
    source, or of one not in the targets, count for the total but are never drawn.
  * null and empty texts have no tokens and are never drawn. Repeated rows of an id count once.
  * the mix is as large as all records together unless a size is given; a record is drawn when the tokens before
    it in its epoch are less than the budget, so a leaf goes over by less than one record.
  * an empty table gives each target zero; targets without records stay under.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import materialize

from .labels import label_key

VOCABULARY = os.environ.get("LOOMLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: How words are cut before merging, as this vocabulary expects it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Domains of the tree by the part of a source's name, the first that occurs in it; a parameter of plan, draw and budgeted.
DOMAINS = {"asr": "speech", "caption": "speech", "ocr": "screen", "code": "screen", "notes": "notes", "handout": "notes", "glossary": "notes"}
#: Records of one leaf are summed in so many hash ranges, so no task ever orders a whole leaf.
SLICES = 4096


def source_key(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-_]+", "_")


_encoders: dict[str, object] = {}


def _encoder(path: str, content: bytes | None = None):
    """Built once in a worker, however many tasks it runs; of the file's ``content``, or of the file."""
    if path not in _encoders:
        import tiktoken

        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of each row. The vocabulary is read by the driver and sent to the executors: a file of fixed size."""
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, content.value)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    return df.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id bigint, source string, lang string, n_tokens bigint")


@dataclass
class Node:
    """A node of the tree: weight is its part of the whole mix, capacity what it can supply at most, both in tokens or shares."""

    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    below: dict[str, "Node"] = field(default_factory=dict)


def allot(node: Node, amount: float) -> float:
    """Give ``amount`` to the subtree; returns what it couldn't take.

    Each child gets its weight's part; what full children leave goes to their siblings by weight until all are full or
    nothing is left, and the rest is the caller's: siblings before ancestors.
    """
    take = min(amount, node.capacity)
    node.budget = take
    if node.below:
        open_ = {k: c for k, c in node.below.items() if c.capacity > 0}
        given = dict.fromkeys(open_, 0.0)
        rest = take
        while rest > 1e-9 and open_:
            total = sum(c.weight for c in open_.values())
            part = {k: rest * (c.weight / total if total > 0 else 1 / len(open_)) for k, c in open_.items()}
            rest = 0.0
            for k in list(open_):
                child = open_[k]
                room = child.capacity - given[k]
                used = min(part[k], room)
                given[k] += used
                rest += part[k] - used
                if given[k] >= child.capacity - 1e-9:
                    del open_[k]
        for k, g in given.items():
            allot(node.below[k], g)
    return amount - take


def domain_of(source: str, domains: dict[str, str] = DOMAINS) -> str:
    return next((d for part, d in domains.items() if part in source), "other")


def sizes(documents: DataFrame, lang_sample: DataFrame | None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, n_tokens) with names in one spelling, one row per id."""
    lang = label_key(F.col("lang"), lang_sample) if lang_sample is not None else F.lower(F.trim("lang"))
    base = documents.select(F.col("doc_id").cast("long"), "source", "lang", "text").filter(F.col("doc_id").isNotNull())
    # counted first, so that no text is shuffled to find repeated rows
    return with_tokens(base, vocabulary).dropDuplicates(["doc_id"]).select("doc_id", source_key("source").alias("source"), F.coalesce(lang, F.lit("und")).alias("lang"), "n_tokens")


def targets(mix: DataFrame) -> DataFrame:
    """One row per source; a repeated name adds its share up and keeps the larger number of repeats."""
    return (
        mix.filter("source_name IS NOT NULL")
        .groupBy(source_key("source_name").alias("source"))
        .agg(
            F.first("source_name").alias("source_name"),
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
            F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"),
        )
    )


def supply(measured: DataFrame, mix: DataFrame) -> DataFrame:
    """Per target source: its tokens, what it can supply, and whether it stays under its share of a mix as large as all."""
    own = measured.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))
    total = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))  # of the same exchange: texts are counted once
    return (
        targets(mix)
        .join(own, "source", "left")
        .join(F.broadcast(total))  # one row
        .withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "records": F.coalesce("records", F.lit(0))})
        .withColumn("possible_share", F.coalesce(F.try_divide(F.col("tokens") * F.col("max_repeats"), F.col("total")), F.lit(0.0)))
        .withColumn("stays_under", F.col("possible_share") < F.col("target_share"))
    )


def plan(measured: DataFrame, mix: DataFrame, size: int | None = None, domains: dict[str, str] = DOMAINS) -> list[tuple]:
    """(source, lang, tokens, max_repeats, budget) of each leaf. The leaves are targets times languages: a small, bounded list."""
    return budgets(measured, mix, size, domains)[0]


def budgets(measured: DataFrame, mix: DataFrame, size: int | None = None, domains: dict[str, str] = DOMAINS) -> tuple[list[tuple], int]:
    """The leaves of plan(), and the size of the mix."""
    wanted = {r["source"]: r for r in targets(mix).collect()}
    own = materialize(measured.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")))  # read twice: texts are counted once
    leaves = own.join(F.broadcast(measured.sparkSession.createDataFrame([(s,) for s in wanted], "source string")), "source").collect() if wanted else []
    size = size if size is not None else own.agg(F.sum("tokens")).first()[0] or 0
    of_source: dict[str, int] = {}
    for r in leaves:
        of_source[r["source"]] = of_source.get(r["source"], 0) + r["tokens"]
    root = Node()
    for r in sorted(leaves, key=lambda r: (r["source"], r["lang"])):
        w = wanted[r["source"]]
        domain = root.below.setdefault(domain_of(r["source"], domains), Node())
        language = domain.below.setdefault(r["lang"], Node())
        weight = w["target_share"] * r["tokens"] / of_source[r["source"]] if of_source[r["source"]] else 0.0
        leaf = language.below[r["source"]] = Node(weight, float(r["tokens"] * w["max_repeats"]))
        for node in (language, domain, root):
            node.weight += leaf.weight
            node.capacity += leaf.capacity
    allot(root, float(size))
    tokens = {(r["source"], r["lang"]): r["tokens"] for r in leaves}
    return [(s, l, tokens[s, l], wanted[s]["max_repeats"], leaf.budget) for d in root.below.values() for l, language in d.below.items() for s, leaf in language.below.items()], size


def budgeted(measured: DataFrame, mix: DataFrame, size: int | None = None, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """Per target source: the budget and the capacity of its leaves in the planned tree, and whether it stays under its share.

    A source stays under when all its leaves together can't hold its target of the mix, whatever the tree gives them.
    """
    leaves, size = budgets(measured, mix, size, domains)
    of_leaf = measured.sparkSession.createDataFrame(leaves, "source string, lang string, leaf_tokens bigint, max_repeats int, budget double")
    own = of_leaf.groupBy("source").agg(F.sum("budget").alias("budget"), F.sum(F.col("leaf_tokens") * F.col("max_repeats")).alias("capacity"))
    return (
        targets(mix)
        .join(F.broadcast(own), "source", "left")  # at most a row per target
        .withColumns({"budget": F.coalesce("budget", F.lit(0.0)), "capacity": F.coalesce("capacity", F.lit(0))})
        .withColumn("possible_share", F.coalesce(F.try_divide("capacity", F.lit(size)), F.lit(0.0)))
        .withColumn("stays_under", F.col("possible_share") < F.col("target_share"))
    )


def redistribution(measured: DataFrame, mix: DataFrame, size: int | None = None, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """(source_name, domain, target_tokens, capacity, budget, moved) per target source: moved is what it takes over from others that
    can't fill their shares (positive), or can't fill itself (negative)."""
    plans = budgeted(measured, mix, size, domains)
    total = size if size is not None else measured.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    domain = F.lit("other")
    for part, name in reversed(domains.items()):
        domain = F.when(F.contains("source", F.lit(part)), name).otherwise(domain)
    wanted = F.col("target_share") * F.lit(float(total))
    return plans.select("source_name", domain.alias("domain"), F.round(wanted).cast("long").alias("target_tokens"), F.col("capacity").cast("long").alias("capacity"), F.round("budget").cast("long").alias("budget"), F.round(F.col("budget") - wanted).cast("long").alias("moved"))


def draw(measured: DataFrame, mix: DataFrame, seed: int = 17, size: int | None = None, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """(doc_id, source, lang, n_tokens, repeats): the records of the mix with how often each is used."""
    spark = measured.sparkSession
    measured = materialize(measured)
    leaves = spark.createDataFrame(plan(measured, mix, size, domains), "source string, lang string, leaf_tokens bigint, max_repeats int, budget double")
    epochs = F.floor(F.col("budget") / F.greatest(F.col("leaf_tokens"), F.lit(1))).cast("int")
    # the records of the last, partial epoch: a token-prefix in the seeded order, summed over hash ranges first
    rows = measured.filter("n_tokens > 0").join(F.broadcast(leaves), ["source", "lang"]).withColumn("whole", F.least(epochs, F.col("max_repeats")))
    ordered = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))).withColumn("slice", F.pmod(F.shiftrightunsigned("draw", 52), F.lit(SLICES)).cast("int"))
    per_slice = ordered.groupBy("source", "lang", "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    before = per_slice.withColumn("before_slice", F.sum("slice_tokens").over(Window.partitionBy("source", "lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("source", "lang", "slice").orderBy(F.shiftrightunsigned("draw", 1), "draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(before.drop("slice_tokens"), ["source", "lang", "slice"]).withColumn("before", F.coalesce("before_slice", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    partial = F.col("budget") - F.col("whole") * F.col("leaf_tokens")
    more = ((F.col("whole") < F.col("max_repeats")) & (F.col("before") + 0.5 < partial)).cast("int")
    return placed.withColumn("repeats", F.col("whole") + more).filter("repeats > 0").select("doc_id", "source", "lang", "n_tokens", "repeats")


def actual_shares(drawn: DataFrame, mix: DataFrame) -> DataFrame:
    """Per target source: its share of the mix as drawn, beside the target."""
    used = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats"))
    total = used.agg(F.sum("mixed_tokens").alias("mix_tokens"))
    return (
        targets(mix)
        .join(used, "source", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "source_name",
            "target_share",
            F.coalesce(F.try_divide("mixed_tokens", "mix_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.coalesce("uses", F.lit(0)).alias("uses"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )

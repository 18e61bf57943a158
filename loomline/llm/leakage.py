"""Test passages that leaked into a corpus (prefix-filtered set join over word shingles).

An item leaks into a document when at least half of its words stand there in the item's order, in one passage, in
unbroken runs of ``width`` or more words. Such runs hold at least ceil(needed / width) of the item's shingles, so with
the item's s shingles ordered by rarity in the corpus, one of its s - needed + 1 rarest must be in the document: only
these prefix shingles are joined. Candidates pass a length bound (enough shared shingles) and a positional bound (they
lie in one window of the item's size), then the shingles' places are covered exactly, window by window.

Defined results
  * null or empty texts and texts of fewer than ``width`` words: no rows; items of fewer than ``width`` words never leak.
  * repeated rows of a document or item give one row; equal items of different ids are each reported.
  * letter case, punctuation, spacing, invisible characters, caption times, quote marks and line-end hyphens don't matter.
  * very long texts are processed whole; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.grouped import map_groups
from loomline.session import materialize

from .words import passage_words, shingle_hashes

#: Up to so many item shingles (8 bytes each) are sent to the executors; more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


def _shingles(df: DataFrame, id_column: str, text_column: str, width: int, wanted=None) -> DataFrame:
    """(id, shingle, pos, n_words); with ``wanted``, a broadcast sorted array, only the shingles in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        for batch in batches:
            ids: list = []
            hashes, places, sizes = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = passage_words(text)
                found = shingle_hashes(words, width)
                pos = np.arange(len(found), dtype=np.int32)
                if keep is not None and len(found):
                    at = np.minimum(np.searchsorted(keep, found), len(keep) - 1)
                    hit = keep[at] == found
                    found, pos = found[hit], pos[hit]
                if len(found):
                    ids.append(np.full(len(found), i, np.int64))
                    hashes.append(found)
                    places.append(pos)
                    sizes.append(np.full(len(found), len(words), np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hashes, places, sizes)], names=["id", "shingle", "pos", "n_words"])

    source = df.select(F.col(id_column).cast("long"), F.col(text_column)).filter(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    return source.mapInArrow(run, "id bigint, shingle bigint, pos int, n_words int")


def _best_chain(d: list[int], i: list[int], width: int) -> tuple[int, int, int]:
    """(words covered, first and last document word) of the best chain of shared shingles, ordered by document place.

    A shingle adds one word to the run it continues, or ``width`` words to the best chain that ends before it in both texts; a
    Fenwick tree of prefix maxima over the item's places holds the chains that end before it in the document.
    """
    low, size = min(i), max(i) - min(i) + 1
    tree = [(0, 0)] * (size + 1)
    at: dict[tuple[int, int], tuple[int, int]] = {}
    ended, found = 0, (0, 0, 0)
    for x, y in zip(d, i):
        while d[ended] + width <= x:
            have = at[d[ended], i[ended]]
            k = i[ended] - low + 1
            while k <= size:
                tree[k] = max(tree[k], have)
                k += k & -k
            ended += 1
        before, k = (0, 0), y - low - width + 1
        while k > 0:
            before = max(before, tree[k])
            k -= k & -k
        best = (before[0] + width, before[1] if before[0] else x)
        if run := at.get((x - 1, y - 1)):
            best = max(best, (run[0] + 1, run[1]))
        at[x, y] = best
        if best[0] > found[0]:
            found = (best[0], best[1], x + width - 1)
    return found


def cover(doc_pos: np.ndarray, item_pos: np.ndarray, n_words: int, width: int, window: int, least: int = 0) -> tuple[int, int, int]:
    """(words covered, first and last document word) of the best passage: the most item words that stand in the item's order, in
    runs of ``width`` or more words, inside any ``window`` document words.

    Runs that follow each other in both texts inside one window are all taken. Else each window that holds shared shingles no
    earlier one holds is searched on its own, so what lies before it never lowers the result; runs may be cut at its ends and
    where they overlap. Windows that can't cover ``least`` words, or more than those found, are left out.
    """
    order = np.lexsort((doc_pos, doc_pos.astype(np.int64) - item_pos))
    d, i = doc_pos[order].astype(np.int64), item_pos[order].astype(np.int64)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] - i[1:] != d[:-1] - i[:-1]) | (d[1:] != d[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    runs = sorted(zip(d[first].tolist(), i[first].tolist(), (d[last] - d[first] + width).tolist()))
    begin, end = runs[0][0], runs[-1][0] + runs[-1][2]
    if end - begin <= window and all(da + na <= db and ia + na <= ib for (da, ia, na), (db, ib, _) in zip(runs, runs[1:])):
        return sum(n for _, _, n in runs), begin, end - 1
    order = np.lexsort((i, d))
    d, i = d[order], i[order]
    starts, lo = np.unique(d, return_index=True)
    hi = np.searchsorted(d, starts + window - width, side="right")
    # document words up to each start's shingle that stand in any shared one
    words = np.cumsum(np.minimum(np.diff(starts, prepend=starts[0] - width), width))
    upto = np.searchsorted(starts, starts + window - width, side="right") - 1
    most = words[upto] - words + width
    found = (0, 0, 0)
    for k in np.flatnonzero((np.diff(hi, prepend=0) > 0) & (most >= least)):
        if found[0] >= n_words:
            break
        held = np.unique(i[lo[k] : hi[k]])
        bound = min(int(most[k]), width + int(np.minimum(np.diff(held), width).sum()))  # item words in any shared shingle
        if bound >= least and bound > found[0]:
            found = max(found, _best_chain(d[lo[k] : hi[k]].tolist(), i[lo[k] : hi[k]].tolist(), width), key=lambda x: x[0])
    return found


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    share: float = 0.5,
    slack: float = 2.0,
) -> DataFrame:
    """(doc_id, item_id, covered_words, item_words, first_word, last_word) of every leak.

    ``slack``: a passage may be so many times as long as the item.
    """
    spark = documents.sparkSession
    own = materialize(_shingles(items, item_id, item_text, width).distinct())
    n_own = own.count()
    if n_own <= BROADCAST_SHINGLES:
        values = np.array([r[0] for r in own.select("shingle").distinct().collect()], np.int64) if n_own else np.array([0], np.int64)
        hits = _shingles(documents, doc_id, doc_text, width, spark.sparkContext.broadcast(np.sort(values)))
    else:
        hits = _shingles(documents, doc_id, doc_text, width).join(own.select("shingle").distinct(), "shingle", "left_semi")
    hits = materialize(hits.select(F.col("id").alias("doc_id"), "shingle", "pos").distinct())
    own = own.select(F.col("id").alias("item_id"), "shingle", F.col("pos").alias("item_pos"), F.col("n_words").alias("item_words"))

    rarity = hits.groupBy("shingle").agg(F.count("*").alias("in_corpus"))
    per_item = own.groupBy("item_id", "shingle", "item_words").agg(F.min("item_pos").alias("at")).join(rarity, "shingle", "left")
    by_rarity = Window.partitionBy("item_id").orderBy(F.coalesce("in_corpus", F.lit(0)), "shingle")
    needed_words = F.ceil(F.col("item_words") * share)
    needed = F.ceil(needed_words / width)
    prefix = (
        per_item.withColumns({"rank": F.row_number().over(by_rarity), "distinct_shingles": F.count("*").over(Window.partitionBy("item_id"))})
        # repeats inside an item lower what a document must share, so the bound uses distinct shingles only
        .filter(F.col("rank") <= F.greatest(F.lit(1), F.col("distinct_shingles") - F.when(F.col("distinct_shingles") == F.col("item_words") - width + 1, needed).otherwise(1) + 1))
        .filter(F.col("in_corpus").isNotNull())
        .select("item_id", "shingle")
    )
    candidates = hits.select("doc_id", "shingle").distinct().join(prefix, "shingle").select("doc_id", "item_id").distinct()
    matches = candidates.join(own, "item_id").join(hits, ["doc_id", "shingle"]).select("doc_id", "item_id", "pos", "item_pos", "item_words")

    def verify(table: pa.Table) -> pa.Table | None:
        doc, item, pos, at, size = (table.column(c).to_numpy() for c in ("doc_id", "item_id", "pos", "item_pos", "item_words"))
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]]))
        rows = []
        for a, b in zip(edge[:-1], edge[1:]):
            n = int(size[a])
            need = -(-n * share // 1)
            # length bound: too few distinct shingles can't cover enough words
            if width * len(np.unique(at[a:b])) < need:
                continue
            covered, first, last = cover(pos[a:b], at[a:b], n, width, int(n * slack) + width, int(need))
            if covered >= n * share:
                rows.append((int(doc[a]), int(item[a]), covered, n, first, last))
        if not rows:
            return None
        names = ["doc_id", "item_id", "covered_words", "item_words", "first_word", "last_word"]
        return pa.table({k: pa.array(v, pa.int64() if k.endswith("_id") else pa.int32()) for k, v in zip(names, zip(*rows))})

    return map_groups(matches, ["doc_id", "item_id"], verify, "doc_id bigint, item_id bigint, covered_words int, item_words int, first_word int, last_word int")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: in how many documents it leaked and how much of it at most."""
    found = leaked_items(documents, items)
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max(F.col("covered_words") / F.col("item_words")).alias("most_covered"))

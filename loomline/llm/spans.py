"""Long spans shared between records (collinear chaining of k-mer seeds).

Seeds are the minimizers of a text's k-mers: of each ``span - k + 1`` neighbouring k-mers the one with the
smallest hash. Any span of ``span`` equal characters has the same minimizers in both texts, so every shared span of
that length meets in at least one seed. Texts that are equal as a whole are joined as one class first.

Pairs aren't made within a seed: a passage that many texts hold would give the square of their number, each with both texts. Instead
the texts with shared seeds are read once more, and each window of ``span`` characters around such a seed gives its hash. The texts
that hold a window are its holders; windows with the same holders are one passage, its holder with the smallest id represents
it, and only the representative is compared with each other holder. For such a pair the seeds are chained in order with gap costs
through a Fenwick tree, and each chain is aligned: its seeds grow to their longest exact extents (the spans), and the gaps between
them are aligned too (the fuzzy passages). A passage's holders that have a span with its representative are linked to each other.

Hot seeds and windows are only ever pre-aggregated or joined on, never collected into one task.

Defined results
  * null and empty texts, and texts shorter than the span: no rows.
  * equal texts form a class; one representative is compared, shared_spans gives representatives plus membership,
    found_pairs also the pairs inside and across classes.
  * repeated rows of a document count once. Very long texts are processed whole. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import materialize

_BASE = 0x9E3779B97F4A7C15 | 1
#: So many characters are hashed at once.
SCAN_CHARS = 1_000_000
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rolling polynomial hash, mixed, of each k-mer of character codes."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers, inverse = _powers(_BASE, n), _powers(_INVERSE, n - k + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
        h = (prefix[k:] - prefix[:-k]) * inverse
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def window_smallest(h: np.ndarray, window: int) -> np.ndarray:
    """Of each window, the position of its leftmost smallest hash, by doubling: log(window) passes."""
    value, at, done = h, np.arange(len(h)), 1
    while done < window:
        step = min(done, window - done)
        right = value[step:]
        later = right < value[: len(right)]
        value, at = np.where(later, right, value[: len(right)]), np.where(later, at[step:], at[: len(right)])
        done += step
    return at


def minimizers(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the minimizers of many texts, one after another in ``codes``.

    All are hashed and scanned in one pass; only windows that lie in one text count, and texts shorter than the span have none.
    """
    h = kmer_hashes(codes, k)
    window = span - k + 1
    n_windows = np.maximum(size - span + 1, 0)
    if not n_windows.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    smallest = window_smallest(h, window)
    owner = np.repeat(np.arange(len(size)), n_windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    chosen = smallest[begin[owner] + offset]
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]  # they never fall within a text
    chosen, owner = chosen[new], owner[new]
    return owner, chosen - begin[owner], h[chosen]


def seeds(df: DataFrame, k: int, span: int) -> DataFrame:
    """(doc_id, seed, pos) of texts of at least ``span`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            # parts of about a million characters keep the arrays small; a longer text is a part of its own
            part = np.cumsum(size) // SCAN_CHARS
            for cut in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
                codes = np.frombuffer("".join(texts[i] for i in cut).encode("utf-32-le", "surrogatepass"), np.uint32)
                owner, place, h = minimizers(codes, np.cumsum(size[cut]) - size[cut], size[cut], k, span)
                yield pa.RecordBatch.from_arrays([pa.array(ids[cut][owner]), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32))], names=["doc_id", "seed", "pos"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, seed bigint, pos int")


class Fenwick:
    """Prefix maxima with their owners."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def update(self, at: int, value: float, owner: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, owner)
            at += at & -at

    def query(self, upto: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while upto > 0:
            if self.best[upto][0] > found[0]:
                found = self.best[upto]
            upto -= upto & -upto
        return found


def chain(a: list[int], b: list[int], k: int, gap: float) -> list[list[int]]:
    """Chains of anchors (a[i], b[i]) that rise in both texts; a gap of g characters on either side costs gap * g.

    With score f(i) = k + max(0, max over j before i of f(j) - gap * ((a_i - a_j) + (b_i - b_j))), the
    cost splits into terms of i and j, so a Fenwick tree of prefix maxima over b answers the inner maximum in log time.
    A chain ends where starting anew is better.
    """
    order = sorted(range(len(a)), key=lambda i: (a[i], b[i]))
    level = {v: r for r, v in enumerate(sorted(set(b)))}
    tree, score, parent = Fenwick(len(level)), [0.0] * len(a), [-1] * len(a)
    waiting: list[int] = []
    for n, i in enumerate(order):
        if n and a[order[n - 1]] != a[i]:
            for j in waiting:
                tree.update(level[b[j]], score[j] + gap * (a[j] + b[j]), j)
            waiting = []
        found, owner = tree.query(level[b[i]])
        gain = found - gap * (a[i] + b[i])
        score[i], parent[i] = (k + gain, owner) if owner >= 0 and gain > 0 else (float(k), -1)
        waiting.append(i)
    used, chains = set(), []
    for i in sorted(range(len(a)), key=lambda i: -score[i]):
        if i in used:
            continue
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.append(i)
            i = parent[i]
        chains.append(path[::-1])
    return chains


def common_length(x: str, y: str, i: int, j: int, forward: bool) -> int:
    """How many characters agree from places i and j on (or before them), in slices that double and then halve."""
    most = min(len(x) - i, len(y) - j) if forward else min(i, j)
    done, step = 0, 64
    while done < most:
        size = min(step, most - done)
        if forward:
            same = x[i + done : i + done + size] == y[j + done : j + done + size]
        else:
            same = x[i - done - size : i - done] == y[j - done - size : j - done]
        if same:
            done += size
            step *= 2
        elif size == 1:
            break
        else:
            most, step = done + size, size // 2
    return done


def align(x: str, y: str, anchors: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(start in x, start in y, length) of each maximal exact match that holds an anchor."""
    found: dict[tuple[int, int], int] = {}
    covered: dict[int, int] = {}
    for i, j in sorted(anchors):
        if i < covered.get(i - j, -1) or x[i : i + k] != y[j : j + k]:
            continue
        back, ahead = common_length(x, y, i, j, False), common_length(x, y, i, j, True)
        found[(i - back, j - back)] = back + ahead
        covered[i - j] = i + ahead
    return [(i, j, n) for (i, j), n in found.items()]


#: So many pairs of a seed's places are looked at together.
PLACE_PAIRS = 1_000_000


def anchors_of(seed_places: list[tuple[list[int], list[int]]], x: str, y: str, k: int) -> tuple[list[int], list[int]]:
    """Anchors of a pair. Where a text repeats itself, a seed has many places in both: of those on one diagonal only such are
    left out as an exact match that is already grown covers, so each maximal match keeps an anchor."""
    a: list[int] = []
    b: list[int] = []
    many: list[tuple[np.ndarray, np.ndarray]] = []
    for at_x, at_y in seed_places:
        if len(at_x) * len(at_y) <= 4:
            for p in at_x:
                for q in at_y:
                    a.append(p)
                    b.append(q)
            continue
        ys = np.array(at_y, np.int64)
        step = max(1, PLACE_PAIRS // len(ys))
        for at in range(0, len(at_x), step):
            xs = np.array(at_x[at : at + step], np.int64)
            diagonal = (xs[:, None] - ys[None, :]).ravel()
            place = np.repeat(xs, len(ys))
            order = np.lexsort((place, diagonal))
            diagonal, place = diagonal[order], place[order]
            # k-mers that touch or overlap on a diagonal lie in one match, whatever the texts' own repetition
            first = np.ones(len(place), bool)
            first[1:] = (diagonal[1:] != diagonal[:-1]) | (place[1:] - place[:-1] > k)
            many.append((diagonal[first], place[first]))
    if many:
        diagonals, places = (np.concatenate(m) for m in zip(*many))
        order = np.lexsort((places, diagonals))
        on, upto = None, -1
        for d, p in zip(diagonals[order].tolist(), places[order].tolist()):
            if d != on:
                on, upto = d, -1
            if p >= upto and x[p : p + k] == y[p - d : p - d + k]:
                a.append(p)
                b.append(p - d)
                upto = p + common_length(x, y, p, p - d, True)
    return a, b


def chained_matches(x: str, y: str, seeds_x: dict[int, list[int]], seeds_y: dict[int, list[int]], k: int, gap: float) -> Iterator[list[tuple[int, int, int]]]:
    """The exact matches of each chain of seeds that two texts share."""
    a, b = anchors_of([(at, seeds_y[s]) for s, at in seeds_x.items() if s in seeds_y], x, y, k)
    for path in chain(a, b, k, gap):
        if matches := align(x, y, [(a[i], b[i]) for i in path], k):
            yield matches


def common_characters(x: str, y: str) -> int:
    """The length of the longest common subsequence, with a bit per character of x: linear steps over y."""
    if not x or not y:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(x):
        places[ch] = places.get(ch, 0) | (1 << i)
    row = full = (1 << len(x)) - 1
    for ch in y:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def align_chain(x: str, y: str, spans: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """(begin and end in x, begin and end in y, characters in common) of a chain's exact matches with the gaps between them aligned."""
    placed: list[tuple[int, int, int]] = []
    for i, j, n in sorted(spans):
        if placed:
            over = max(0, placed[-1][0] + placed[-1][2] - i, placed[-1][1] + placed[-1][2] - j)
            i, j, n = i + over, j + over, n - over
        if n > 0:
            placed.append((i, j, n))
    common = sum(n for _, _, n in placed)
    for (i, j, n), (p, q, _) in zip(placed, placed[1:]):
        common += common_characters(x[i + n : p], y[j + n : q])
    (i, j, _), (p, q, n) = placed[0], placed[-1]
    return i, p + n, j, q + n, common


def text_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 300) -> tuple[DataFrame, DataFrame]:
    """(texts, membership): equal texts are one class, named by its smallest id.

    Classes are made on a 128-bit digest, pre-aggregated before the shuffle, so no text is moved and a text held by a third
    of all rows is one row per partition.
    """
    base = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter((F.length("text") >= span) & F.col("doc_id").isNotNull())
    digest = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.reverse("text"), F.length("text")).alias("b"))
    keyed = base.select("doc_id", digest.alias("digest")).distinct()
    heads = keyed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    members = keyed.join(heads, "digest").select("doc_id", "class_id", "n_copies")
    return base, members


def window_hashes(df: DataFrame, k: int, span: int) -> DataFrame:
    """(doc_id, window) of each window of ``span`` characters around one of the seeds of (doc_id, text, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, found: list) -> pa.RecordBatch:
            owner = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
            return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "window"])

        for batch in batches:
            ids, found, held = [], [], 0
            for doc, text, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits"))):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                h = kmer_hashes(codes, span)
                # of the windows that hold the seed, others may have another smallest; they are some text's shared windows or nobody's
                at = np.array([p for hit in hits for p in hit["places"]], np.int64)
                marks = np.zeros(len(h) + 1, np.int64)
                np.add.at(marks, np.maximum(at - (span - k), 0), 1)
                np.add.at(marks, np.minimum(at + 1, len(h)), -1)
                ids.append(doc)
                found.append(np.unique(h[np.cumsum(marks)[:-1] > 0]))
                held += len(found[-1])
                if held >= SCAN_CHARS:
                    yield flush(ids, found)
                    ids, found, held = [], [], 0
            if ids:
                yield flush(ids, found)

    return df.select("doc_id", "text", "hits").mapInArrow(run, "doc_id bigint, window bigint")


def passage_holders(windows: DataFrame) -> DataFrame:
    """(passage, head, doc_id) of (doc_id, window): the holders of each passage, windows with the same holders being one.

    A set of holders is known by two sums (exclusive or) of the ids' hashes, their number and the smallest id.
    """
    sums = [F.bit_xor(F.xxhash64("doc_id", F.lit(salt))).alias(f"sum_{salt}") for salt in (1, 2)]
    held = windows.groupBy("window").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"), *sums).filter("n > 1")
    passages = held.groupBy("head", "n", "sum_1", "sum_2").agg(F.min("window").alias("window")).select("window", "head")
    return windows.join(passages, "window").select(F.col("window").alias("passage"), "head", "doc_id")


def compared(documents: DataFrame, span: int = 300, k: int = 100, gap: float = 0.1, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, holders, membership): what comparing each passage's representative with its other holders gives, the holders of each
    passage, and the classes of equal texts. found has a row per exact span (chain null) and per chain (as its alignment)."""
    texts, members = text_classes(documents, doc_id, text, span)
    members = materialize(members)
    # seeds of all rows are taken first and then cut to the representatives': no text is moved for it
    found = seeds(texts, k, span).join(members.filter("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    found = materialize(found)
    shared = found.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("seed")
    # the seeds that two texts share are few; only their texts are moved, once
    hits = found.join(shared, "seed").groupBy("doc_id", "seed").agg(F.sort_array(F.collect_set("pos")).alias("places")).groupBy("doc_id").agg(F.collect_list(F.struct("seed", "places")).alias("hits"))
    used = materialize(texts.join(hits, "doc_id").dropDuplicates(["doc_id"]))
    holders = materialize(passage_holders(window_hashes(used, k, span)))
    pairs = holders.filter("doc_id != head").select(F.col("head").alias("doc_a"), F.col("doc_id").alias("doc_b")).distinct()
    for side in "ba":
        pairs = pairs.join(used.select(F.col("doc_id").alias(f"doc_{side}"), F.col("text").alias(f"text_{side}"), F.col("hits").alias(f"hits_{side}")), f"doc_{side}")
    names = ["doc_a", "doc_b", "a_start", "a_end", "b_start", "b_end", "length", "n_spans", "chain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 7]
        for batch in batches:
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                a, b, x, y, hits_a, hits_b = (batch.column(c)[row].as_py() for c in ("doc_a", "doc_b", "text_a", "text_b", "hits_a", "hits_b"))
                places = [{h["seed"]: h["places"] for h in hits} for hits in (hits_a, hits_b)]
                for n, matches in enumerate(chained_matches(x, y, *places, k, gap)):
                    rows += [(a, b, i, i + m, j, j + m, m, 1, None) for i, j, m in matches if m >= span]
                    rows.append((a, b, *align_chain(x, y, matches), len(matches), n))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_a bigint, doc_b bigint, " + ", ".join(f"{c} int" for c in names[2:])
    return pairs.select("doc_a", "doc_b", "text_a", "text_b", "hits_a", "hits_b").mapInArrow(run, schema), holders, members


def shared_spans(documents: DataFrame, span: int = 300, **kw) -> tuple[DataFrame, DataFrame]:
    """(matches, membership). matches: (doc_a, doc_b, a_start, b_start, length), one row per maximal exact match of ``span`` or more
    characters between a passage's representative and each other text that holds the passage."""
    found, _, members = compared(documents, span, **kw)
    return found.filter("chain IS NULL").select("doc_a", "doc_b", "a_start", "b_start", "length").distinct(), members


def fuzzy_passages(documents: DataFrame, span: int = 300, **kw) -> DataFrame:
    """(doc_a, doc_b, a_start, a_end, b_start, b_end, common, n_spans, similarity): each chain of ``span`` or more common characters as
    one passage, aligned over its gaps; similarity is twice the characters in common by those of both sides."""
    chains = compared(documents, span, **kw)[0].filter((F.col("chain").isNotNull()) & (F.col("length") >= span))
    both = F.col("a_end") - F.col("a_start") + F.col("b_end") - F.col("b_start")
    return chains.select("doc_a", "doc_b", "a_start", "a_end", "b_start", "b_end", F.col("length").alias("common"), "n_spans", F.round(2 * F.col("length") / both, 4).alias("similarity")).distinct()


def passage_members(documents: DataFrame, **kw) -> DataFrame:
    """(passage, head, doc_id): the documents, copies included, that hold each passage, with the class that represents it."""
    _, holders, members = compared(documents, **kw)
    return holders.withColumnRenamed("doc_id", "class_id").join(members.select("class_id", "doc_id"), "class_id").select("passage", "head", "doc_id")


def links(found: DataFrame, holders: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: class representatives that hold the same passage and have a span with what represents it."""
    proven = found.filter("chain IS NULL").select(F.col("doc_a").alias("head"), F.col("doc_b").alias("doc_id")).distinct()
    held = materialize(holders.join(proven, ["head", "doc_id"], "left_semi").unionByName(holders.filter("doc_id = head")))
    left, right = (held.select("passage", F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    return left.join(right, "passage").filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def found_pairs(documents: DataFrame, span: int = 300, **kw) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of documents that share a span, pairs of copies included."""
    found, holders, members = compared(documents, span, **kw)
    of_a = members.select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("x"))
    of_b = members.select(F.col("class_id").alias("doc_b"), F.col("doc_id").alias("y"))
    across = links(found, holders).join(of_a, "doc_a").join(of_b, "doc_b").select("x", "y")
    inside = of_a.join(of_b.withColumnRenamed("doc_b", "doc_a"), "doc_a").filter("x < y").select("x", "y")
    # classes are disjoint and linked once, so no pair comes twice
    return across.unionByName(inside).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_share(documents: DataFrame, span: int = 300, **kw) -> DataFrame:
    """Per document: its class, the number of other texts it is linked to, and how many of its characters stand elsewhere."""
    found, holders, members = compared(documents, span, **kw)
    found = materialize(found)
    matches = found.filter("chain IS NULL")
    size = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars")).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    # every shared span of a text lies in a passage, and is met where the text is compared for it
    ends = matches.select(F.col("doc_a").alias("class_id"), F.col("a_start").alias("s"), F.col("a_end").alias("e")).unionByName(matches.select(F.col("doc_b").alias("class_id"), F.col("b_start").alias("s"), F.col("b_end").alias("e")))
    pairs = links(found, holders)
    both = pairs.select(F.col("doc_a").alias("class_id")).unionByName(pairs.select(F.col("doc_b").alias("class_id")))
    n_links = both.groupBy("class_id").agg(F.count("*").alias("n_links"))
    # union of intervals: a fold over the distinct starts, each with its farthest end
    spans = ends.groupBy("class_id", "s").agg(F.max("e").alias("e")).groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    covered = F.expr("aggregate(spans, named_struct('n', 0, 'to', -1), (acc, x) -> named_struct('n', acc.n + greatest(0, x.e - greatest(x.s, acc.to)), 'to', greatest(acc.to, x.e)), acc -> acc.n)")
    by_class = n_links.join(spans.select("class_id", covered.alias("covered")), "class_id")
    out = size.join(members, "doc_id", "left").join(by_class, "class_id", "left")
    has_copy = F.coalesce(F.col("n_copies"), F.lit(1)) > 1
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(has_copy, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("shared_chars"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )

"""Repetition inside one text: divergence from a language's reference as a proven gate, then an exact count.

Each text's histogram of common words and of character classes is compared to its language's reference by Jensen-Shannon distance.
A text of n words half of which lie in repeated runs has at most n / 2 different words, as a word's first place is never in a run
said before. A histogram on so few classes can't come closer to a reference than one on the reference's n / 2 largest classes in
their own proportions: that distance is the ``bound`` of the text's length. Texts under it are proven not to be stuck, whatever
the reference was learnt from, and aren't counted; all others are counted exactly: a word is repeated when it lies in a run of
four or more words that stood earlier in the same text. Texts of fewer than MIN_GATE_WORDS words have too rough a histogram for the
distance to tell (the minimum-length guard) and are always counted.

``gate`` is reported beside it: the distance that fresh texts of half the length, drawn from the reference itself, stay above
(GATE_SPREADS standard deviations below their mean). It tells stuck texts from others far better, but isn't proven: a text that
makes up much of its language's reference is close to it however stuck it is. So it decides nothing.

References are learnt from the corpus in one pass: word counts per language, cut to the COMMON most frequent words of each (a
bounded table) and one class for all other words. A text's language is the one whose labelled sentences hold most of its words;
without any such word, the script most of its letters are in stands for it.

Defined results
  * null and empty texts, and texts of fewer than eight words: share 0 (operator) and no case (found).
  * case, punctuation and digits don't matter: digits and punctuation are dropped, words without letters vanish.
  * repeated rows count once; very long texts are processed whole in linear time; extra columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import materialize

COMMON = 3000
MIN_GATE_WORDS = 64
GATE_SPREADS = 4.0
_DROP = regex.compile(r"[^\p{L}\p{M}\s]+")
#: Classes of characters in the histogram.
_CLASS_KEY = "#"
CLASSES = ("upper", "lower", "letter", "mark", "digit", "space", "punctuation", "other")


def said_words(text: str) -> list[str]:
    """Words as repetition is judged: lower-case letters and marks only."""
    return _DROP.sub("", text.lower()).split()


def repeated_share(words: list[str], run: int = 4) -> float:
    """Share of the words that lie in runs of ``run`` or more words said earlier in the text."""
    n = len(words)
    if n < run:
        return 0.0
    if n <= 5000:
        seen: set[tuple[str, ...]] = set()
        covered, upto = 0, 0
        for i in range(n - run + 1):
            gram = tuple(words[i : i + run])
            if gram in seen:
                covered += i + run - max(i, upto)
                upto = i + run
            else:
                seen.add(gram)
        return covered / n
    code: dict[str, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    # exact ids of runs by pairing ids step by step
    grams = ids[: n - run + 1]
    for k in range(1, run):
        pair = grams * (n + 1) + ids[k : n - run + 1 + k]
        grams = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    first = np.full(int(grams.max()) + 1, n, np.int64)
    np.minimum.at(first, grams, np.arange(len(grams)))
    again = np.flatnonzero(first[grams] < np.arange(len(grams)))
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + run, -1)
    return float((np.cumsum(marks)[:n] > 0).mean())


def script_of(text: str) -> str:
    """The script of most of a text's letters, as the first word of a letter's Unicode name."""
    seen: dict[str, int] = {}
    for ch, n in Counter(text).items():
        if ch.isalpha():
            key = "LATIN" if ch < "ɐ" else unicodedata.name(ch, "OTHER").split(" ", 1)[0]
            seen[key] = seen.get(key, 0) + n
    return max(sorted(seen), key=lambda k: seen[k]) if seen else "NONE"


def word_owners(lang_sample: DataFrame) -> dict[str, str]:
    """Words that only one language of the fixed labelled sentences uses, with that language."""
    found: dict[str, set[str]] = {}
    for r in lang_sample.select(F.lower(F.trim("lang")).alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        for w in said_words(r["text"]):
            found.setdefault(w, set()).add(r["lang"])
    return {w: min(langs) for w, langs in found.items() if len(langs) == 1}


def language_key(text: str, words: list[str], owners: dict[str, str]) -> str:
    """The reference a text is compared to: the language that owns most of its words, else its script."""
    votes: dict[str, int] = {}
    for w in words:
        if (lang := owners.get(w)) is not None:
            votes[lang] = votes.get(lang, 0) + 1
    return max(sorted(votes), key=lambda k: votes[k]) if votes else script_of(text)


def class_counts(text: str) -> list[int]:
    """How many characters of each of CLASSES."""
    out = [0] * len(CLASSES)
    for ch, c in Counter(text).items():
        kind = unicodedata.category(ch)
        at = {"Lu": 0, "Ll": 1}.get(kind)
        if at is None:
            at = 5 if ch.isspace() else {"L": 2, "M": 3, "N": 4, "Z": 5, "P": 6}.get(kind[0], 7)
        out[at] += c
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, square root) of two histograms on the same classes."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


class Reference:
    """A language's common words with their shares (the last class is all other words), and its gates by length."""

    def __init__(self, words: list[tuple[str, int]], total: int, classes: list[int] | None = None) -> None:
        self.place = {w: i for i, (w, _) in enumerate(words)}
        counts = np.array([n for _, n in words] + [max(0, total - sum(n for _, n in words))], float)
        self.shares = counts / max(1.0, counts.sum())
        self.classes = np.array(classes or [1] * len(CLASSES), float)
        self.classes /= max(1.0, self.classes.sum())
        self.top = np.cumsum(np.sort(self.shares)[::-1])
        self.gates: dict[int, float] = {}

    def distance(self, words: list[str]) -> float:
        """Word histogram's distance: sparse, as classes absent from the text add half their reference share."""
        other = len(self.shares) - 1
        counts: dict[int, int] = {}
        for w in words:
            i = self.place.get(w, other)
            counts[i] = counts.get(i, 0) + 1
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        return self._distance(at, np.fromiter(counts.values(), np.float64, len(counts)) / len(words))

    def _distance(self, at: np.ndarray, p: np.ndarray) -> float:
        q = self.shares[at]
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = (p * np.log2(p / m) + np.where(q > 0, q * np.log2(q / m), 0.0)).sum()
        absent = 1.0 - q.sum()
        return float(np.sqrt(max(0.0, (inside + absent) / 2)))

    def gate(self, n: int) -> float:
        """Mean less GATE_SPREADS deviations of fresh texts of about n / 2 words; lengths are rounded up to powers of 1.25, so that the gate is never above the true one."""
        step = int(np.ceil(np.log(max(n, 2)) / np.log(1.25)))
        if step not in self.gates:
            size = int(1.25**step) // 2 + 1
            rng = np.random.default_rng(step)
            got = []
            for _ in range(40):
                drawn, counts = np.unique(rng.choice(len(self.shares), size=size, p=self.shares), return_counts=True)
                got.append(self._distance(drawn, counts / size))
            self.gates[step] = float(np.mean(got) - GATE_SPREADS * np.std(got))
        return self.gates[step]

    def bound(self, n: int) -> float:
        """The least distance of a histogram on n // 2 classes: with a share m of the reference on the largest of them, and these in
        their own proportions. (The distance is convex in the histogram and falls as m grows.)"""
        if n < 2:
            return 0.0
        m = float(min(self.top[min(n // 2, len(self.top)) - 1], 1.0))
        inside = np.log2(2 / (1 + m)) + m * np.log2(2 * m / (1 + m)) if m > 0 else 1.0
        return max(0.0, float(np.sqrt(max(0.0, (inside + 1 - m) / 2))) - 1e-6)  # less the rounding of a root near zero


def _texts(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    kinds = ((transcripts, "transcript", "transcript_id"), (segments, "segment", "segment_id"))
    parts = [df.select(F.lit(kind).alias("item_kind"), F.col(key).cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull() & F.col(key).isNotNull()) for df, kind, key in kinds]
    return parts[0].unionByName(parts[1])


def references(texts: DataFrame, common: int = COMMON, owners: dict[str, str] | None = None) -> dict[str, tuple[list[tuple[str, int]], int, list[int]]]:
    """Per language key: its ``common`` most frequent words with counts, all words' count, and its histogram of character classes.

    Counts are pre-aggregated in the workers and then by Spark; only the cut list, bounded by languages times ``common``, reaches
    the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], int] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["script", "word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = said_words(text)
                script = language_key(text, words, owners or {})
                for w in words:
                    key = (script, w)
                    found[key] = found.get(key, 0) + 1
                for k, c in enumerate(class_counts(text)):
                    key = (script, f"{_CLASS_KEY}{k}")
                    found[key] = found.get(key, 0) + c
                if len(found) > 200_000:
                    yield flush()
        if found:
            yield flush()

    counts = materialize(texts.select("text").mapInArrow(run, "script string, word string, n bigint").groupBy("script", "word").agg(F.sum("n").alias("n")))
    is_class = F.col("word").startswith(_CLASS_KEY)
    totals = {r["script"]: r["n"] for r in counts.filter(~is_class).groupBy("script").agg(F.sum("n").alias("n")).collect()}
    classes: dict[str, list[int]] = {s: [0] * len(CLASSES) for s in totals}
    for r in counts.filter(is_class).collect():  # languages times classes
        if r["script"] in classes:
            classes[r["script"]][int(r["word"][1:])] = r["n"]
    # the languages are a handful, so one bounded top-k of each is a distributed top-k without a window over a hot script
    out = {}
    for script, total in totals.items():
        top = counts.filter(~is_class & (F.col("script") == script)).orderBy(F.desc("n"), "word").limit(common).collect()
        out[script] = ([(r["word"], r["n"]) for r in top], total, classes[script])
    return out


def repetition(transcripts: DataFrame, segments: DataFrame, min_words: int = 8, gated: bool = False, lang_sample: DataFrame | None = None, share: float = 0.5) -> DataFrame:
    """(item_kind, item_id, n_words, language, word_distance, class_distance, bound, gate, repeated_share) of every text; repeated_share is exact.

    gated: only the texts of at least ``min_words`` words that their bound doesn't rule out, which are all that can have a share of
    ``share`` (one half or more); gate and class_distance, which decide nothing, are left out.
    """
    if gated and share < 0.5:
        raise ValueError("the bound is proven for shares of one half and more")
    texts = _texts(transcripts, segments)
    owners = word_owners(lang_sample) if lang_sample is not None else {}
    # the words of the segments are those of the transcripts: the references are learnt from these alone
    learnt = references(transcripts.select("text").filter("text IS NOT NULL"), owners=owners)
    shared = texts.sparkSession.sparkContext.broadcast((owners, learnt))  # the fixed sample's words, and COMMON words a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, learnt = shared.value
        known = {s: Reference(*r) for s, r in learnt.items()}
        names = ["item_kind", "item_id", "n_words", "language", "word_distance", "class_distance", "bound", "gate", "repeated_share"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 5]
        for batch in batches:
            rows = []
            for kind, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = said_words(text)
                if gated and len(words) < min_words:
                    continue
                language = distance = of_classes = bound = gate = None
                if len(words) >= MIN_GATE_WORDS:
                    language = language_key(text, words, owners)
                    if reference := known.get(language):
                        distance, bound = reference.distance(words), reference.bound(len(words))
                        if gated and distance < bound:
                            continue
                        if not gated:
                            gate = reference.gate(len(words))
                            histogram = np.array(class_counts(text), float)
                            of_classes = js_distance(histogram / histogram.sum(), reference.classes)
                rows.append((kind, key, len(words), language, distance, of_classes, bound, gate, repeated_share(words) if len(words) >= min_words else 0.0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    found = texts.mapInArrow(run, "item_kind string, item_id bigint, n_words int, language string, word_distance double, class_distance double, bound double, gate double, repeated_share double")
    return found.dropDuplicates(["item_kind", "item_id"])


def stuck_texts(transcripts: DataFrame, segments: DataFrame, share: float = 0.5, lang_sample: DataFrame | None = None) -> DataFrame:
    return repetition(transcripts, segments, gated=share >= 0.5, lang_sample=lang_sample, share=share).filter(F.col("repeated_share") >= share).select("item_kind", "item_id")

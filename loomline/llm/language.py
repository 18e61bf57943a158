"""Language labels by cross-parsing entropy.

A suffix automaton of each language's labelled text parses a text into the longest pieces that occur in that
language; the language that needs the fewest pieces (phrases) per character wins. The automata are dense transition
tables, and all texts of a batch are parsed in lockstep: one table lookup per character position and language
moves every text at once, so the work is linear in the characters and vectorised. Texts of more than PIECE characters are parsed in
pieces that end at blanks, all at once, and their phrases add up; batches are cut by characters, so one long text is no long loop.

The labelled text is lang_sample, a fixed table with a few sentences per language, and a bounded sample of labelled rows:
SAMPLE_CHARS and SAMPLE_ROWS bound what is taken of each language (bounds of the classifier's fit only; every text to
label is read whole).

Defined results
  * null, empty and wordless texts have no language (null, confidence null).
  * confidence is the winner's part of exp(-cost) over the languages, cost being phrases times the log of the sample size
    per phrase, damped for the length of the text; ties go to the smaller code.
  * a label is compared as its code: names, case, regions and suffixes don't matter; placeholders count as missing.
  * repeated rows count once; extra columns of any name aren't read.
  * language_spans: sentences of fewer than SPAN_WORDS words are put together, each such part is labelled, and parts in one language
    that follow each other are one span; a text of one language is one span, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import materialize

from .labels import label_key, names_of

SAMPLE_CHARS = 8_000
SAMPLE_ROWS = 60
PIECE = 2_000
#: So many characters are labelled together.
BATCH_CHARS = 1_500_000
SPAN_WORDS = 6
_SENTENCE = regex.compile(r"[^.!?।॥\n]*[.!?।॥\n]+\s*|[^.!?।॥\n]+$")
_GAP = regex.compile(r"[^\p{L}\p{M}]+")


def normalize(text: str) -> str:
    """Lower-case letters and marks with single blanks between words and at both ends."""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


def piece_cuts(text: str) -> list[int]:
    """Where the pieces of a long text begin: at a blank, at most PIECE characters apart, or anywhere in a longer word."""
    cuts = [0]
    while len(text) - cuts[-1] > PIECE:
        at = text.rfind(" ", cuts[-1] + 1, cuts[-1] + PIECE)
        cuts.append(at if at > 0 else cuts[-1] + PIECE)
    return cuts


def parts_of(sizes: list[int], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each; a longer text is alone or ends its range."""
    begin = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


class CrossParser:
    """One suffix automaton per language, each over its own alphabet: column 0 is any other character."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.codes = sorted(c for c in samples if any(samples[c]))
        texts = {c: [normalize(t) for t in samples[c] if t] for c in self.codes}
        self.sizes = [max(2, sum(map(len, texts[c]))) for c in self.codes]
        self.lookups, self.widths, self.tables = [], [], []
        for c in self.codes:
            alphabet = sorted({ch for x in texts[c] for ch in x})
            lookup = np.zeros(ord(alphabet[-1]) + 2, np.int32)
            lookup[[ord(ch) for ch in alphabet]] = np.arange(1, len(alphabet) + 1)
            self.lookups.append(lookup)
            self.widths.append(len(alphabet) + 1)
            self.tables.append(self._table(texts[c], lookup, len(alphabet) + 1))

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @staticmethod
    def _table(texts: list[str], lookup: np.ndarray, width: int) -> np.ndarray:
        """next state * 4 + phrases begun, for each state and character."""
        link, length, step = [-1], [0], [{}]
        for text in texts:
            last = 0
            for ch in lookup[CrossParser.points(text)].tolist():
                if ch in step[last]:
                    q = step[last][ch]
                    if length[q] == length[last] + 1:
                        last = q
                        continue
                    clone = len(link)
                    link.append(link[q]), length.append(length[last] + 1), step.append(dict(step[q]))
                    link[q] = clone
                    p = last
                    while p >= 0 and step[p].get(ch) == q:
                        step[p][ch] = clone
                        p = link[p]
                    last = clone
                    continue
                now = len(link)
                link.append(0), length.append(length[last] + 1), step.append({})
                p = last
                while p >= 0 and ch not in step[p]:
                    step[p][ch] = now
                    p = link[p]
                if p >= 0:
                    q = step[p][ch]
                    if length[q] == length[p] + 1:
                        link[now] = q
                    else:
                        clone = len(link)
                        link.append(link[q]), length.append(length[p] + 1), step.append(dict(step[q]))
                        link[q] = link[now] = clone
                        while p >= 0 and step[p].get(ch) == q:
                            step[p][ch] = clone
                            p = link[p]
                last = now
        table = np.full((len(step), width), -1, np.int64)
        for s, moves in enumerate(step):
            for ch, to in moves.items():
                table[s, ch] = to * 4
        # no way on: a new phrase begins at this character; unknown characters are phrases of their own
        root = np.where(table[0] >= 0, table[0] + 1, 2)
        table = np.where(table >= 0, table, root[None, :])
        return table.astype(np.int32).ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases per text and language, characters per text, whether parsed) of normalised texts.

        A character that a language doesn't know costs two phrases, so a text's unknown characters bound a
        language's phrases from below. The language with the fewest is parsed first; another one whose
        bound is already dearer can't win and keeps its bound.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        points = self.points("".join(texts))
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = [lookup[np.minimum(points, len(lookup) - 1)] for lookup in self.lookups]
        counts = np.stack([2 * np.add.reduceat(f == 0, begin, dtype=np.int64) for f in flat], axis=1)
        cuts = [piece_cuts(t) if len(t) > PIECE else (0,) for t in texts]
        n_pieces = np.fromiter(map(len, cuts), np.int64, len(cuts))
        owner = np.repeat(np.arange(len(texts)), n_pieces)
        at = np.fromiter((c for cut in cuts for c in cut), np.int64, len(owner))
        ends = np.append(at[1:], 0)
        ends[np.cumsum(n_pieces) - 1] = sizes
        at, size = at + begin[owner], ends - at
        scale = np.log(np.array(self.sizes))
        parsed = np.zeros(counts.shape, bool)
        first = (counts * scale).argmin(axis=1)
        bound = np.empty(len(texts))

        def parse(k: int, chosen: np.ndarray) -> None:
            mine = chosen[owner]
            counts[chosen, k] = 0
            np.add.at(counts[:, k], owner[mine], self._parse(k, flat[k], at[mine], size[mine]))
            parsed[chosen, k] = True

        for k in range(len(self.codes)):
            parse(k, first == k)
            bound[first == k] = counts[first == k, k] * scale[k]
        for k in range(len(self.codes)):
            parse(k, (first != k) & (counts[:, k] * scale[k] <= bound))
        return counts, sizes, parsed

    def _parse(self, k: int, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of some texts in language k, all of them moved by one character at a time."""
        if not len(sizes):
            return np.empty(0, np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin, table, width = begin[order], self.tables[k], self.widths[k]
        # how many texts are at least so long
        alive = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), side="right")
        state, total = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32)
        for at, live in enumerate(alive.tolist()):
            move = table[state[:live] * width + flat[begin[:live] + at]]
            state[:live] = move >> 2
            total[:live] += move & 3
        out = np.empty(len(sizes), np.int64)
        out[order] = total
        return out

    def classify_plain(self, plain: list[str]) -> tuple[list[str | None], list[float | None]]:
        """(language, confidence) of normalised texts."""
        if not self.codes or not plain:
            return [None] * len(plain), [None] * len(plain)
        counts, sizes, parsed = self.phrases(plain)
        # nats per phrase: naming a place in the language's sample; damped, as neighbouring phrases aren't independent
        cost = counts * np.log(np.array(self.sizes))[None, :] / (1 + np.log1p(sizes))[:, None]
        cost[~parsed] = np.inf  # ruled out by their bounds
        best = cost.argmin(axis=1)
        weight = np.exp(-(cost - cost.min(axis=1, keepdims=True)))
        sure = np.round(weight.max(axis=1) / weight.sum(axis=1), 4).tolist()
        return [self.codes[b] if n > 2 else None for b, n in zip(best.tolist(), sizes.tolist())], [c if n > 2 else None for c, n in zip(sure, sizes.tolist())]

    def classify(self, texts: list[str]) -> tuple[list[str | None], list[float | None]]:
        return self.classify_plain([normalize(t) if t else "  " for t in texts])


def samples_of(lang_sample: DataFrame, labelled: DataFrame | None = None, id_column: str = "doc_id", chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Labelled text by code: lang_sample and, of ``labelled``, a bounded sample of texts whose label the sample alone confirms.

    Each language gets as many characters as the one with the fewest has, and at most ``chars``, so that none wins by size. About
    SAMPLE_ROWS rows per label are looked at, drawn by a hash of their id; the bound doesn't grow with the table.
    """
    known = names_of(lang_sample)
    key = label_key(F.col("lang"), known)
    taken: dict[str, list[str]] = {}
    for r in lang_sample.select(key.alias("code"), "text").filter("code IS NOT NULL AND text IS NOT NULL").orderBy("code", "text").toLocalIterator():
        if sum(map(len, taken.get(r["code"], ()))) < chars:
            taken.setdefault(r["code"], []).append(r["text"])
    if labelled is None or not taken:
        return taken
    rows = labelled.select(key.alias("code"), F.col(id_column).alias("id"), "text").filter(F.col("code").isin(*taken) & F.col("text").isNotNull())
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}
    if not counts:
        return taken
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000_000)) / 1e9
    chance = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, SAMPLE_ROWS / n)])
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < F.element_at(chance, F.col("code"))).select("code", "draw", "text").collect()
    drawn.sort(key=lambda r: (r["code"], r["draw"], r["text"]))
    # only parts that the sample alone gives the same language for sure: rows may be mixed or wrongly labelled
    parts = [(r["code"], " ".join(words[i : i + 12])) for r in drawn for words in [r["text"].split()] for i in range(0, len(words), 12)]
    lang, sure = CrossParser(taken).classify([t for _, t in parts])
    more: dict[str, list[str]] = {c: list(t) for c, t in taken.items()}
    for (code, text), found, confidence in zip(parts, lang, sure):
        if found == code and confidence > 0.9:
            more[found].append(text)
    limit = min(chars, min(sum(map(len, t)) for t in more.values()))
    out: dict[str, list[str]] = {}
    for c, texts in more.items():
        size = 0
        for t in texts:
            if size < limit:
                out.setdefault(c, []).append(t[: limit - size])
                size += len(t)
    return out


_parsers: dict[int, CrossParser] = {}


def _parser(samples: dict[str, list[str]]) -> CrossParser:
    """Built once in a worker, however many tasks it runs."""
    key = hash(tuple((c, tuple(t)) for c, t in sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def with_language(df: DataFrame, samples: dict[str, list[str]], keep: str) -> DataFrame:
    """``df`` must have the columns of ``keep`` (a schema) and text; adds true_lang, confidence, n_words and n_distinct."""
    names = [x.split()[0] for x in keep.split(", ")]
    shared = df.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            every = [normalize(t) if t else "  " for t in batch.column(len(names)).to_pylist()]
            for at, end in parts_of([len(p) for p in every]):
                part, plain = batch.slice(at, end - at), every[at:end]
                lang, sure = parser.classify_plain(plain)
                words = [p.split() for p in plain]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array([len(w) for w in words], pa.int64()), pa.array([len(set(w)) for w in words], pa.int64())],
                    names=[*names, "true_lang", "confidence", "n_words", "n_distinct"],
                )

    return df.select(*names, "text").mapInArrow(run, f"{keep}, true_lang string, confidence double, n_words bigint, n_distinct bigint")


def sentence_parts(text: str) -> list[tuple[int, int]]:
    """(begin, end) of parts of whole sentences with SPAN_WORDS words or more.

    Shorter sentences are put together; where a long one comes before they have so many words, they go to the part before.
    """
    parts: list[tuple[int, int]] = []
    begin = words = 0
    for m in _SENTENCE.finditer(text):
        n = len(normalize(m.group()).split())
        if n >= SPAN_WORDS and parts and begin < m.start():
            parts[-1] = (parts[-1][0], m.start())
            begin, words = m.start(), 0
        words += n
        if words >= SPAN_WORDS:
            parts.append((begin, m.end()))
            begin, words = m.end(), 0
    if words and parts:
        parts[-1] = (parts[-1][0], len(text))
    elif words:
        parts.append((0, len(text)))
    return parts


def language_spans(df: DataFrame, samples: dict[str, list[str]], id_column: str = "doc_id") -> DataFrame:
    """(item_id, span_no, first_char, end_char, n_words, lang, confidence) of each span of one language in the texts of (id, text).

    confidence is the mean of the span's parts, weighted by their words.
    """
    shared = df.sparkSession.sparkContext.broadcast(samples)
    schema = "item_id bigint, span_no int, first_char int, end_char int, n_words int, lang string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        types = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.float64()]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, end in parts_of([len(t) for t in texts]):
                cut = [sentence_parts(t) for t in texts[at:end]]
                plain = [normalize(t[a:b]) for t, parts in zip(texts[at:end], cut) for a, b in parts]
                labelled = iter(zip(plain, *parser.classify_plain(plain)))
                rows: list[tuple] = []
                for i, parts in zip(ids[at:end], cut):
                    spans: list[list] = []
                    for a, b in parts:
                        p, lang, sure = next(labelled)
                        n = len(p.split())
                        if spans and spans[-1][3] == lang:
                            spans[-1][1], spans[-1][2], spans[-1][4] = b, spans[-1][2] + n, spans[-1][4] + sure * n
                        elif lang is not None:
                            spans.append([a, b, n, lang, sure * n])
                    rows += [(i, k, a, b, n, lang, round(sure / n, 4)) for k, (a, b, n, lang, sure) in enumerate(spans)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])

    base = df.select(F.col(id_column).cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    return base.mapInArrow(run, schema).dropDuplicates(["item_id", "span_no"])


def _wrong(label: Column, truth: str) -> Column:
    return F.col(truth).isNotNull() & (label.isNull() | (label != F.col(truth)))


def segment_languages(segments: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """One row per segment with an id and a video: its language, words and confidence."""
    base = segments.select(F.col("segment_id").cast("long").alias("segment_id"), "video_id", "text").filter("segment_id IS NOT NULL AND video_id IS NOT NULL AND text IS NOT NULL")
    return with_language(base, samples, "segment_id bigint, video_id string").filter("true_lang IS NOT NULL").dropDuplicates(["segment_id"])


def spoken_languages(segments: DataFrame) -> DataFrame:
    """(video_id, main_lang, confidence): the language of most words of a recording; words are summed before the shuffle."""
    per = segments.groupBy("video_id", "true_lang").agg(F.sum("n_words").alias("words"))
    best = F.max(F.struct("words", F.col("true_lang").alias("lang")))
    return per.groupBy("video_id").agg(best.alias("best"), F.sum("words").alias("all")).select("video_id", F.col("best.lang").alias("main_lang"), F.round(F.col("best.words") / F.col("all"), 4).alias("confidence"))


def language_labels(metadata: DataFrame, segments: DataFrame, documents: DataFrame, lang_sample: DataFrame) -> DataFrame:
    """(item_kind, item_id, label, lang, confidence, is_wrong) of every recording with speech, every document and segment.

    For a segment, label is its recording's main language and is_wrong marks a foreign segment of six or more different words.
    """
    samples = samples_of(lang_sample, documents)
    known = names_of(lang_sample)
    spoken = materialize(segment_languages(segments, samples))  # read twice: texts are parsed once
    main = spoken_languages(spoken)
    label = label_key(F.col("detected_language"), known)
    videos = (
        metadata.select("video_id", label.alias("label"))
        .filter("video_id IS NOT NULL")
        .groupBy("video_id")
        .agg(F.min("label").alias("label"))
        .join(main, "video_id")
        .select(F.lit("video").alias("item_kind"), F.col("video_id").alias("item_id"), "label", F.col("main_lang").alias("lang"), "confidence")
        .withColumn("is_wrong", _wrong(F.col("label"), "lang"))
    )
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), label_key(F.col("lang"), known).alias("label"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = (
        with_language(read, samples, "doc_id bigint, label string")
        .select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_id"), "label", F.col("true_lang").alias("lang"), "confidence")
        .withColumn("is_wrong", _wrong(F.col("label"), "lang"))
        .dropDuplicates(["item_id"])
    )
    foreign = (
        spoken.join(main.select("video_id", "main_lang"), "video_id")
        .select(F.lit("segment").alias("item_kind"), F.col("segment_id").cast("string").alias("item_id"), F.col("main_lang").alias("label"), F.col("true_lang").alias("lang"), "confidence", "n_distinct")
        .withColumn("is_wrong", (F.col("n_distinct") >= 6) & (F.col("lang") != F.col("label")))
        .drop("n_distinct")
    )
    return videos.unionByName(texts).unionByName(foreign)

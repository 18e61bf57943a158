"""Noise of scanned pages and slides, and clean paragraphs without it.

Four kinds per line: running heads and footers, page numbers, words cut at a line end, misread words.
  * Running heads are found by fuzzy line repetition at page edges: the outermost lines of a video's events are compared with those
    at most HEAD_FRAMES frames away, on a key in which characters that scanners confuse are one. A line that stands at the edge of
    several events (whole, truncated, in capitals, misread) is a head; a line next to a head may be one too, however many there are.
  * Page numbers are lines of their own with a number in a page's form, outermost or next to a head, that make a sequence: a number
    without a word, sign or total of pages must rise or fall with the numbers of the neighbouring events (or stand alone there).
  * Cut words and misreads use the corpus vocabulary (word counts over all events): a cut is a hyphen at the line end whose joined
    word isn't far rarer than both halves; a misread word becomes a far more frequent word of the same key by known confusions, or
    is rare and has digits or signs inside letters. All of this compares counts with counts, so it is alike at every corpus size.

Nothing here depends on box confidences, which mislead.

Defined results
  * null or empty texts: no rows. Lines are text split at newlines, counted from 0. Events without a video, or with neither frame
    nor time, stand alone for heads and page numbers. Lines of fewer than MIN_HEAD letters and digits are no heads.
  * a head or page number has no second kind; lines of code have none (code_likelihood, and where it is null or false, a text
    most of whose lines look like code).
  * repeated rows of an event give one row per line and kind. Very long texts are processed whole. Events without a
    frame index are placed by their time. Other columns aren't read.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.grouped import map_groups
from loomline.session import materialize

from .words import LINE_HYPHENS

#: What scanners take characters for: (true, read).
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("t", "f"), ("i", "l"), ("i", "1"), ("s", "5"), ("l", "1"), ("o", "0"), ("g", "9"), ("b", "6"),
    ("u", "ii"), ("d", "cl"), ("h", "li"), ("m", "rn"), ("w", "vv"), ("rn", "m"), ("ci", "d"), ("cl", "d"),
)
_ONE = str.maketrans("@50961l|cf", "asogbiiiet")
#: Letters that are read as pairs, spelled out: their keys then agree however a text is cut into pairs.
_SPELLED = str.maketrans({"m": "rn", "w": "vv", "d": "ei", "u": "ii", "h": "ii"})
_PLAIN = str.maketrans("@50961", "asogbl")

#: Misread-word lists of at most so many entries are sent to the executors, so that other words aren't shuffled; the rows are the
#: same beyond it.
BROADCAST_WORDS = 200_000
#: Heads and page numbers run through the slides of one chunk: events at most so many frames apart are compared. The longest of 2,000
#: chunks lasts 384 s, 9,600 frames of a 25th of a second.
HEAD_FRAMES = 10_000
FRAMES_PER_SECOND = 25
#: Events are handled in ranges of so many frames, each with HEAD_FRAMES on either side; the result doesn't depend on the cuts.
FRAMES_PER_RANGE = 30_000
MIN_HEAD = 5
#: Neighbours in a sequence of page numbers differ by at most so much.
PAGE_STEP = 20
#: A word stays a hyphenated one where the joined word is so many times rarer than each half.
JOINED_RARITY = 1000
#: A true word is more than MUCH_OFTENER times as frequent as its misread form, or OFTENER times if it has LONG_WORD letters: the longer a
#: word, the less likely two true words differ by confusions alone.
MUCH_OFTENER, OFTENER, LONG_WORD = 4, 2, 7
#: A word with digits inside letters, and no known true word, is misread if it makes up at most this share of all words.
RARE_SHARE = 1e-5

_HYPHEN = regex.compile(rf"(\p{{L}}[\p{{L}}\p{{M}}@\d]*+)[{LINE_HYPHENS}]\s*$")
_STARTS_LOW = regex.compile(r"^\s*(\p{Ll}[\p{L}\p{M}@\d]*)")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}@]+")
_TOKEN_ASCII = re.compile(r"[A-Za-z0-9@]+")
_NUMERAL = r"(?:[\dlOoI|]{1,5})"
_ROMAN = r"x{0,3}(?:[il1]x|[il1]v|v?[il1]{0,3})"
_AROUND = r"[\s\-–—_\[\](){}|<>~=•·.]*"
_PAGE = regex.compile(
    rf"^{_AROUND}(?P<mark>(?:page|p\.|pg\.?|slide|s[l1i]ide|folio|seite|folie|página|pagina|diapositiva)\s*)?(?P<number>{_NUMERAL})(?P<total>\s*(?:/|of|von|de|sur)\s*{_NUMERAL})?{_AROUND}$"
    rf"|^[\s\-–—\[\]()]*(?=[xvil1])(?P<roman>{_ROMAN})[\s\-–—\[\]()]*$",
    regex.I,
)
_READ_NUMBER = str.maketrans("lio|", "1101")
_READ_ROMAN = str.maketrans("l1|", "iii")
_ROMAN_VALUE = {"i": 1, "v": 5, "x": 10}
_NOT_PAGE = regex.compile(r"\d[.,:]\s*\d|[%€$]")
_ENDS = regex.compile(r"[.?!,;:…][\s\-–—]*$")
_DIGITS = regex.compile(r"\d+")
_TAIL_NUMBER = regex.compile(r"\s*[|·—–-]\s*[\dlOoI]+\s*$")
#: No line of _CODE is without one of these signs or a statement's first word.
_CODE_SIGN = re.compile(r"[{};$=(]|\b(?:return|SELECT|FROM|WHERE|GROUP BY|ORDER BY|INSERT|UPDATE|JOIN)\b|:\s*$", re.M)
_CODE = regex.compile(
    r"[{};]\s*$|^\s*\$ |=>|^\s*(?:def|class|return|import|from|for|while|if|public|private|const|let|var|function)\b.*[:(){};=]\s*|^\s*return\b|^\s*(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|INSERT|UPDATE|JOIN)\b|^\s*[\w.\[\]]+ = \S|\w\(.*\)\s*$"
)


def is_page(line: str) -> bool:
    """Whether a line is nothing but a number in a page's form."""
    return bool(_PAGE.match(line)) and not _NOT_PAGE.search(line)


def page_of(line: str) -> tuple[str, int, bool] | None:
    """(style, number, marked) of a line in a page's form; marked: a word, signs or a total tell that it is a page's number."""
    found = _PAGE.match(line)
    if not found or _NOT_PAGE.search(line):
        return None
    at = "number" if found["number"] is not None else "roman"
    read = found[at].lower()
    if at == "roman" or ("i" in read and not regex.search(r"[\do]", read)):
        values = [_ROMAN_VALUE[c] for c in read.translate(_READ_ROMAN)]
        value, kind = sum(v if v >= after else -v for v, after in zip(values, [*values[1:], 0])), "i"
    else:
        value, kind = int(read.translate(_READ_NUMBER)), "#"
    # how it is written, whatever the numbers: all of a chunk's are alike
    style = line[: found.start(at)].strip().lower() + kind + (" /#" if found["total"] else line[found.end(at) :].strip())
    return style, value, line.strip() != found[at]


def is_code(text: str, flag: bool | None) -> bool:
    if flag:
        return True
    if not _CODE_SIGN.search(text):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and sum(bool(_CODE.search(x)) for x in lines) * 2 > len(lines)


def confusion_key(text: str) -> str:
    """A key that a word or line shares with all its misread forms; digits that aren't confused stay."""
    return text.lower().translate(_ONE).translate(_SPELLED)


def line_key(line: str) -> str:
    """confusion_key of a line without its page number, spacing and punctuation."""
    line = _TAIL_NUMBER.sub("", unicodedata.normalize("NFKC", line))
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", "", confusion_key(line))


def misread_as(true: str, read: str) -> bool:
    """Whether ``read`` can come of ``true`` by confusions alone."""
    ends = {0: {0}}
    # breadth-first over aligned places: the sets stay tiny as each place has few ways on
    for i in range(len(true) + 1):
        for j in sorted(ends.get(i, ())):
            if i == len(true):
                continue
            if j < len(read) and true[i] == read[j]:
                ends.setdefault(i + 1, set()).add(j + 1)
            for a, b in CONFUSIONS:
                if true.startswith(a, i) and read.startswith(b, j):
                    ends.setdefault(i + len(a), set()).add(j + len(b))
    return true != read and len(read) in ends.get(len(true), ())


_BASE = ("event_id", "video_id", "frame_index", "text", "code_likelihood")


def _base(events: DataFrame) -> DataFrame:
    frame = F.col("frame_index").cast("long")
    if "timestamp_s" in events.columns:
        frame = F.coalesce(frame, F.expr(f"try_cast(round(timestamp_s * {FRAMES_PER_SECOND}) AS bigint)"))
    return events.select(F.col("event_id").cast("long").alias("event_id"), "video_id", frame.alias("frame_index"), "text", "code_likelihood").filter("event_id IS NOT NULL AND text IS NOT NULL AND text != ''")


def whole_words(text: str) -> Iterator[tuple[int, str]]:
    """(line_pos, lower-case word) of all words that aren't halves of one cut at a line end."""
    held = False
    find = (_TOKEN_ASCII if text.isascii() else _TOKEN).findall
    for pos, line in enumerate(text.lower().split("\n")):
        words = find(line)
        if held and words:
            del words[0]
        held = cut_word(line) is not None
        if held and words:
            words.pop()
        for w in words:
            yield pos, w


def cut_word(line: str) -> str | None:
    """The letters before a hyphen at the line end."""
    if line.rstrip()[-1:] not in LINE_HYPHENS:
        return None
    found = _HYPHEN.search(line)
    return found.group(1) if found else None


def vocabulary(events: DataFrame) -> DataFrame:
    """(word, n) over all events that aren't code; counted in the workers before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not is_code(text, flag):
                    for _, w in whole_words(text):
                        found[w] = found.get(w, 0) + 1
            if len(found) > 200_000:
                yield flush()
        if found:
            yield flush()

    return _base(events).select("text", "code_likelihood").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_SIGN_INSIDE = regex.compile(r"^(?:\p{L}+[@01569]+\p{L}[\p{L}@01569]*|[@01569]\p{L}{3,}[\p{L}@01569]*|\p{L}*@\p{L}*)$")
_NUMBER_READ = regex.compile(r"^(?=.*\d)(?=.*[lo])[\dlo]{2,5}$")


def misread_words(words: DataFrame) -> DataFrame:
    """(word, fix) of the misread words of a vocabulary; fix is null where the corpus doesn't know the true word."""
    # beyond its first time, a rare word may come RARE_SHARE times as often as all words do
    rare = 1 + RARE_SHARE * (words.agg(F.sum("n")).first()[0] or 0)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str | None]] = []
            for group in batch.column(0).to_pylist():
                known = sorted(((g["n"], g["word"]) for g in group), reverse=True)
                for n, w in known:
                    odd = any(c in "@015691" for c in w)
                    if _NUMBER_READ.match(w):
                        out.append((w, w.replace("l", "1").replace("o", "0")))
                        continue
                    fix = next((v for m, v in known if (m > MUCH_OFTENER * n or (len(v) >= LONG_WORD and m >= OFTENER * n) or (odd and m >= n)) and v.isalpha() and len(v) > 2 and misread_as(v, w)), None)
                    if fix is not None or (n <= rare and _SIGN_INSIDE.match(w) and sum(c.isalpha() for c in w) >= 3 and w.translate(_PLAIN).isalpha()):
                        out.append((w, fix))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["word", "fix"])

    key = F.udf(confusion_key, "string", useArrow=True)
    # words of one key are few: the forms of one word
    groups = words.withColumn("key", key("word")).groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("group"))
    odd = F.exists("group", lambda g: g["word"].rlike("[0-9@]"))
    return groups.filter((F.size("group") > 1) | odd).select("group").mapInArrow(decide, "word string, fix string")


def edge_lines(events: DataFrame) -> DataFrame:
    """The outermost lines at the top and bottom of each event with what decides about them: the first two, and further ones as long
    as all before them have a head's or page number's form. ``rank`` counts the lines of a head's form from the edge."""
    schema = "video_id string, frame_index bigint, event_id bigint, line_pos int, at_top boolean, depth int, rank int, key string, page string, number bigint, marked boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows = []
            for event, video, frame, text, flag in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if is_code(text, flag):
                    continue
                lines = text.split("\n")
                for top in (True, False):
                    rows += [(video, frame, event, pos, top, *rest) for pos, *rest in edge_of(lines, top)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return _base(events).select(*_BASE).mapInArrow(run, schema)


def edge_of(lines: list[str], top: bool) -> Iterator[tuple]:
    """(line_pos, depth, rank, key, page style, number, marked) from the edge inwards; key is null where a line is no head by its form."""
    n, rank = len(lines), 0
    for depth in range(n):
        pos = depth if top else n - 1 - depth
        line = lines[pos]
        if page := page_of(line):
            yield pos, depth, None, None, *page
            continue
        # next to a head stands the begin or end of a sentence, or its page number
        inner = pos + 1 if top else pos - 1
        near = lines[inner] if 0 <= inner < n else ""
        if not near.strip() or is_page(near):
            fits = True
        elif top:
            fits = not regex.match(r"\s*\p{Ll}", near)
        else:
            fits = bool(_ENDS.search(near)) or bool(regex.search(r"[–—-]\s*$", near))
        key = line_key(line) if not _ENDS.search(line) else ""
        may = len(key) >= MIN_HEAD
        if may or depth < 2:
            yield pos, depth, rank if may else None, key if may else None, "fits" if may and fits else None, None, None
        if not (may and fits):
            return
        rank += 1


def _alike(a: str, b: str) -> bool:
    """One line as read twice: equal, cut at its begin, or nearly equal where both are whole."""
    if min(len(a), len(b)) < 8:
        return False
    if a.endswith(b) or b.endswith(a):
        return True
    if abs(len(a) - len(b)) > 3 or _DIGITS.findall(a) != _DIGITS.findall(b):
        return False
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9


def alike_keys(keys: list[str]) -> dict[str, list[str]]:
    """Of each key, the keys (itself too) whose line is the same in another shape; keys that share pieces of five characters are compared."""
    pieces: dict[str, list[str]] = defaultdict(list)
    own = {key: {key[i : i + 5] for i in range(0, max(1, len(key) - 4))} for key in keys}
    for key, mine in own.items():
        for piece in mine:
            pieces[piece].append(key)
    out = {}
    for key, mine in own.items():
        shared: dict[str, int] = defaultdict(int)
        for piece in mine:
            for other in pieces[piece]:
                shared[other] += 1
        out[key] = [key, *(other for other, n in shared.items() if other != key and 3 * n >= min(len(mine), max(1, len(other) - 4)) and _alike(key, other))]
    return out


def head_and_page_lines(events: DataFrame, range_frames: int = FRAMES_PER_RANGE) -> DataFrame:
    """(event_id, line_pos, noise) of running heads and page numbers.

    A video's events are spread over ranges of ``range_frames`` frames; each range also sees HEAD_FRAMES frames on either side,
    and an event is compared with those within HEAD_FRAMES of itself alone. So a busy video is many groups and none depends on
    another, nor on where the ranges are cut.
    """
    lines = edge_lines(events).dropDuplicates(["event_id", "line_pos", "at_top"])
    lone = F.col("video_id").isNull() | F.col("frame_index").isNull()
    entity = F.when(lone, F.concat(F.lit("\x00"), F.col("event_id").cast("string"))).otherwise(F.col("video_id"))
    lines = lines.withColumns({"entity": entity, "frame_index": F.when(lone, F.lit(0)).otherwise(F.col("frame_index"))})
    first, last = (F.floor((F.col("frame_index") + m) / range_frames).cast("long") for m in (-HEAD_FRAMES, HEAD_FRAMES))
    spread = lines.drop("video_id").withColumn("slot", F.explode(F.sequence(first, last)))

    def decide(table: pa.Table) -> pa.Table | None:
        columns = {c: table.column(c).to_pylist() for c in ("entity", "slot", "frame_index", "event_id", "line_pos", "at_top", "depth", "rank", "key", "page", "number", "marked")}
        groups: dict[tuple, list[int]] = defaultdict(list)
        for i, g in enumerate(zip(columns["entity"], columns["slot"])):
            groups[g].append(i)
        rows: list[tuple[int, int, str]] = []
        for (_, slot), members in groups.items():
            _decide(columns, members, range(slot * range_frames, (slot + 1) * range_frames), rows)
        return pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()), "line_pos": pa.array([r[1] for r in rows], pa.int32()), "noise": pa.array([r[2] for r in rows], pa.string())}) if rows else None

    found = map_groups(spread, ["entity", "slot"], decide, "event_id bigint, line_pos int, noise string")
    return found.distinct()


class Support:
    """In how many events around a frame each key's line stands, in whatever shape."""

    def __init__(self, held: list[tuple[str, int, int]]) -> None:
        """From (key, frame, event)."""
        self.places: dict[str, dict[int, int]] = defaultdict(dict)
        for key, frame, event in held:
            self.places[key][event] = frame
        self.alike = alike_keys(list(self.places))
        self.known: dict[str, list[int]] = {}

    def at(self, key: str, frame: int) -> int:
        if key not in self.known:
            events: dict[int, int] = {}
            for k in self.alike[key]:
                events |= self.places[k]
            self.known[key] = sorted(events.values())
        frames = self.known[key]
        return bisect_right(frames, frame + HEAD_FRAMES) - bisect_left(frames, frame - HEAD_FRAMES)


class Sequences:
    """The numbers in a page's form of each style and side, in the order of their frames."""

    def __init__(self, numbers: list[tuple[tuple, int, int]]) -> None:
        """From ((style, side), frame, number)."""
        self.runs: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for of, frame, number in numbers:
            self.runs[of].append((frame, number))
        for run in self.runs.values():
            run.sort()

    def confirm(self, of: tuple, frame: int, number: int, may_be_alone: bool) -> bool:
        """Whether a number rises or falls with another one near it, or has none near and may be alone."""
        run = self.runs[of]
        alone = True
        for f, v in run[bisect_left(run, (frame - HEAD_FRAMES,)) : bisect_right(run, (frame + HEAD_FRAMES, float("inf")))]:
            if f != frame:
                alone = False
                if 0 < (v - number) * (1 if f > frame else -1) <= PAGE_STEP:
                    return True
        return alone and may_be_alone


def _decide(c: dict[str, list], members: list[int], frames: range, rows: list[tuple[int, int, str]]) -> None:
    sides: dict[tuple[int, bool], list[int]] = defaultdict(list)
    for i in members:
        sides[c["event_id"][i], c["at_top"][i]].append(i)
    held: dict[int, list] = defaultdict(list)
    numbers = []
    for side in sides.values():
        side.sort(key=lambda i: c["depth"][i])
        for i in side:
            if c["rank"][i] is not None:
                held[c["rank"][i]].append((c["key"][i], c["frame_index"][i], c["event_id"][i]))
            elif c["number"][i] is not None:
                numbers.append(((c["page"][i], c["at_top"][i]), c["frame_index"][i], c["number"][i]))
    support = {rank: Support(h) for rank, h in held.items()}
    sequences = Sequences(numbers)
    for (event, top), side in sides.items():
        frame = c["frame_index"][side[0]]
        if frame not in frames:
            continue  # another range decides about this event
        numbered = False
        for i in side:
            if c["number"][i] is not None:
                # one number a side: outermost or under a head; a bare one under a head isn't a second one of the event
                style, number, marked = c["page"][i], c["number"][i], c["marked"][i]
                other = sides.get((event, not top))
                second = numbered or (c["depth"][i] > 0 and not marked and other and c["number"][other[0]] is not None)
                may_be_alone = number < 1000 and not (style == "i" and number in (1, 5, 10))
                if second or not (marked or sequences.confirm((style, top), frame, number, may_be_alone)):
                    break
                rows.append((event, c["line_pos"][i], "page_number"))
                numbered = True
                continue
            if c["page"][i] != "fits":
                break
            n = support[c["rank"][i]].at(c["key"][i], frame)
            if not (n >= 3 or n >= 2 and len(c["key"][i]) >= 12):
                break
            rows.append((event, c["line_pos"][i], "running_head"))


def word_noise(events: DataFrame, words: DataFrame, wrong: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, misreads): (event_id, line_pos, joined) and (event_id, line_pos, word, fix)."""
    spark = events.sparkSession
    fixes = spark.sparkContext.broadcast(frozenset(r["word"] for r in wrong.select("word").collect())) if wrong.count() <= BROADCAST_WORDS else None

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = fixes.value if fixes is not None else None
        for batch in batches:
            rows: list[tuple] = []
            for event, text, flag in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if is_code(text, flag):
                    continue
                rows += [(event, pos, w, None, None) for pos, w in whole_words(text) if have is None or w in have]
                lines = text.split("\n")
                for pos, (line, after) in enumerate(zip(lines, lines[1:])):
                    if (left := cut_word(line)) and (right := _STARTS_LOW.match(after)):
                        rows.append((event, pos, None, left.lower(), right.group(1).lower()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.string()] * 3))], names=["event_id", "line_pos", "word", "left", "right"])

    tagged = _base(events).select("event_id", "text", "code_likelihood").mapInArrow(tag, "event_id bigint, line_pos int, word string, left string, right string").distinct()
    if fixes is None:
        tagged = tagged.join(wrong.select("word", F.lit(True).alias("is_wrong")), "word", "left").filter("is_wrong OR left IS NOT NULL").drop("is_wrong")
    tagged = materialize(tagged)
    cut = tagged.filter("left IS NOT NULL").select("event_id", "line_pos", "left", "right", F.concat("left", "right").alias("joined"))
    for part in ("joined", "left", "right"):
        cut = cut.join(words.select(F.col("word").alias(part), F.col("n").alias(f"n_{part}")), part, "left")
    count = lambda part: F.coalesce(f"n_{part}", F.lit(0))
    cut = cut.filter(count("joined") * JOINED_RARITY >= F.least(count("left"), count("right"))).select("event_id", "line_pos", "joined")

    return cut, tagged.filter("word IS NOT NULL").select("event_id", "line_pos", "word").join(wrong, "word")


def noise_details(events: DataFrame) -> DataFrame:
    """(event_id, line_pos, noise, word, fix): one row per noisy word or line."""
    words = materialize(vocabulary(events))
    wrong = materialize(misread_words(words))
    edges = materialize(head_and_page_lines(events))
    cut, read = word_noise(events, words, wrong)
    body = cut.select("event_id", "line_pos", F.lit("broken_word").alias("noise"), F.col("joined").alias("word"), F.col("joined").alias("fix")).unionByName(read.select("event_id", "line_pos", F.lit("misread").alias("noise"), "word", "fix"))
    body = body.join(edges.select("event_id", "line_pos"), ["event_id", "line_pos"], "left_anti")
    nothing = F.lit(None).cast("string")
    return body.unionByName(edges.select("event_id", "line_pos", "noise", nothing.alias("word"), nothing.alias("fix")))


def noisy_lines(events: DataFrame) -> DataFrame:
    return noise_details(events).select("event_id", "line_pos", "noise").distinct()


def clean_paragraphs(events: DataFrame) -> DataFrame:
    """(event_id, paragraphs, removed_lines, fixed_words): each event's text without noise as running paragraphs.

    Lines of a paragraph are joined by blanks, cut words without their hyphen; a line that ends a sentence well short of the
    longest line ends a paragraph. Code keeps its lines.
    """
    notes = noise_details(events).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("line_pos", "noise", "word", "fix"))).alias("notes"))
    rows = _base(events).select("event_id", "text", "code_likelihood").dropDuplicates(["event_id"]).join(notes, "event_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for event, text, flag, notes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if is_code(text, flag):
                    out.append((event, text, 0, 0))
                else:
                    out.append((event, *rebuild(text, notes or [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["event_id", "paragraphs", "removed_lines", "fixed_words"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("event_id", pa.int64()), ("paragraphs", pa.string()), ("removed_lines", pa.int32()), ("fixed_words", pa.int32())]))

    return rows.select("event_id", "text", "code_likelihood", "notes").mapInArrow(run, "event_id bigint, paragraphs string, removed_lines int, fixed_words int")


def rebuild(text: str, notes: list[dict]) -> tuple[str, int, int]:
    lines = text.split("\n")
    drop = {n["line_pos"] for n in notes if n["noise"] in ("running_head", "page_number")}
    cut = {n["line_pos"] for n in notes if n["noise"] == "broken_word"}
    fixes: dict[int, dict[str, str]] = defaultdict(dict)
    for n in notes:
        if n["noise"] == "misread" and n["fix"]:
            fixes[n["line_pos"]][n["word"]] = n["fix"]
    fixed = 0
    longest = max((len(x) for i, x in enumerate(lines) if i not in drop), default=0)
    out, open_ = [], ""
    for i, line in enumerate(lines):
        if i in drop:
            continue

        def swap(m, at=i):
            nonlocal fixed
            fix = fixes[at].get(m.group().lower()) if at in fixes else None
            if fix is None:
                return m.group()
            fixed += 1
            return fix.capitalize() if m.group()[0].isupper() else fix

        line = _TOKEN.sub(swap, line).strip()
        if not line:
            continue
        if i in cut:
            open_ += regex.sub(r"[-‐‑¬­]\s*$", "", line)
            continue
        open_ += line
        if _ENDS.search(line) and len(line) < 0.75 * longest:
            out.append(open_)
            open_ = ""
        else:
            open_ += " "
    if open_.strip():
        out.append(open_.strip())
    return "\n\n".join(out), len(drop), fixed

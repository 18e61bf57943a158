import random

import pytest

from loomline.llm import language
from loomline.llm.labels import label_key

SAMPLES = {"en": ["the river runs below the old bridge and we see it", "not every teacher keeps the notes of the lesson"], "de": ["der fluss fließt unter der alten brücke und wir sehen ihn", "nicht jede lehrerin behält die notizen der stunde"]}


def brute_phrases(text, sample):
    """Greedy longest matches by substring search."""
    texts = [language.normalize(t) for t in sample]
    n = i = 0
    while i < len(text):
        size = 0
        while i + size < len(text) and any(text[i : i + size + 1] in t for t in texts):
            size += 1
        n += 1
        i += max(1, size)
    return n


@pytest.mark.parametrize("seed", range(5))
def test_automaton_parses_like_substring_search(seed):
    rng = random.Random(seed)
    parser = language.CrossParser(SAMPLES)
    texts = [" ".join(rng.choice((SAMPLES["en"] + SAMPLES["de"])[k % 4].split()) for k in range(rng.randrange(1, 12))) for _ in range(20)]
    plain = [language.normalize(t) for t in texts]
    counts, _, parsed = parser.phrases(plain)
    for row, t, seen in zip(counts, plain, parsed):
        for k, code in enumerate(parser.codes):
            if seen[k]:
                want = brute_phrases(t, SAMPLES[code])
                unknown = sum(not any(ch in language.normalize(x) for x in SAMPLES[code]) for ch in t)
                # an unknown character costs one phrase more, and the first phrase is counted when it begins
                assert abs(row[k] - want) <= 1 + unknown


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    samples = language.samples_of(spark.read.parquet(f"{d}/lang_sample.parquet"))
    held = {c: t[-3:] for c, t in samples.items()}
    parser = language.CrossParser({c: t[:-3] for c, t in samples.items()})
    right = sum(parser.classify(t)[0].count(c) for c, t in held.items())
    assert right >= 0.9 * sum(map(len, held.values()))


def test_labels(spark):
    names = {"en": "en", "english": "en", "hi": "hi", "hindi": "hi"}
    data = [(x,) for x in ("en-GB", " EN", "English", "en_us", "auto", "??", "", None, "hi-orig", "pa", "nan")]
    got = [r[0] for r in spark.createDataFrame(data, "l string").select(label_key(language.F.col("l"), names)).collect()]
    assert got == ["en", "en", "en", "en", None, None, None, None, "hi", "pa", None]


def tables(spark):
    en, de = "we see the old river below the bridge and keep the notes", "wir sehen den alten fluss unter der brücke und behalten die notizen"
    meta = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("b", "de", 1), ("c", "English", 1), ("d", "en", 1), (None, "en", 1)], "video_id string, detected_language string, lang int")
    seg = [(i, v, t, "x") for i, (v, t) in enumerate([("a", en), ("a", en), ("a", de), ("b", en), ("b", en), ("c", en), ("c", "der fluss"), ("c", None), ("c", ""), (None, de)])]
    seg = spark.createDataFrame(seg + seg[:2], "segment_id bigint, video_id string, text string, confidence string")
    docs = spark.createDataFrame([(1, en, "de", 0), (2, de, "German", 0), (3, de, None, 0), (4, "", "en", 0), (5, None, None, 0), (6, "12 34", "en", 0), (7, en, "en-GB", 0)], "doc_id bigint, text string, lang string, label int")
    sample = spark.createDataFrame([(1, "en", "English", SAMPLES["en"][0]), (2, "en", "English", SAMPLES["en"][1]), (3, "de", "German", SAMPLES["de"][0]), (4, "de", "German", SAMPLES["de"][1])], "sample_id bigint, lang string, lang_name string, text string")
    return meta, seg, docs, sample


def test_labels_of_odd_rows(spark):
    meta, seg, docs, sample = tables(spark)
    got = {(r["item_kind"], r["item_id"], r["lang"]) for r in language.language_labels(meta, seg, docs, sample).filter("is_wrong").collect()}
    assert got == {("video", "a", "en"), ("video", "b", "en"), ("segment", "2", "de"), ("document", "1", "en"), ("document", "3", "de")}


def test_empty_tables(spark):
    meta, seg, docs, sample = tables(spark)
    assert language.language_labels(meta.limit(0), seg.limit(0), docs.limit(0), sample).count() == 0
    assert language.language_labels(meta, seg, docs, sample.limit(0)).filter("is_wrong").count() == 0


def test_long_texts_are_parsed_in_pieces():
    parser = language.CrossParser(SAMPLES)
    short = "we see the old river below the bridge and keep the notes of every teacher "
    long = [short * 200, "x" * 9000, (short * 40) + "nicht jede lehrerin behält die notizen der stunde " * 200, short]
    cuts = language.piece_cuts(language.normalize(long[0]))
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= language.PIECE and cuts == sorted(set(cuts)) and len(language.piece_cuts("x" * 9000)) == 5
    lang, sure = parser.classify(long)
    assert lang[0] == lang[3] == "en" and lang[2] == "de" and sure[0] > 0.9
    plain = [language.normalize(t) for t in long]
    counts, _, parsed = parser.phrases(plain)
    alone = parser.phrases([plain[3]])[0][0]
    k = parser.codes.index("en")
    assert parsed[0, k] and abs(counts[0, k] - 200 * alone[k]) <= 200 + len(cuts)
    assert list(language.parts_of([5, 5, 30, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)] and list(language.parts_of([])) == []


def test_spans_of_mixed_texts(spark):
    en, de = "We see the old river below the bridge. Every teacher keeps the notes of the lesson.", "Wir sehen den alten Fluss unter der Brücke. Jede Lehrerin behält die Notizen."
    rows = [(1, f"{en} {de} {en}", 0), (1, f"{en} {de} {en}", 0), (2, de, 0), (3, "", 0), (4, None, 0), (5, "12. 34!", 0), (None, en, 0), (6, "Ja.", 0)]
    got = {}
    for r in language.language_spans(spark.createDataFrame(rows, "doc_id bigint, text string, lang int"), SAMPLES).collect():
        got.setdefault(r["item_id"], []).append((r["span_no"], r["lang"], r["first_char"], r["end_char"], r["confidence"]))
    spans = sorted(got[1])
    text = rows[0][1]
    assert [s[1] for s in spans] == ["en", "de", "en"] and text[spans[1][2] : spans[1][3]].strip() == de and all(0.5 < s[4] <= 1 for s in spans)
    assert [s[1] for s in got[2]] == ["de"] and set(got) <= {1, 2, 6}

import pytest

from loomline.llm import scans

SCHEMA = "event_id bigint, video_id string, frame_index bigint, text string, code_likelihood boolean, slot string, key int"


@pytest.mark.parametrize("true,read,yes", [("every", "evcry", True), ("their", "tlieir", True), ("modern", "modem", True), ("mutex", "miifex", True), ("beyond", "bcyoncl", True), ("same", "same", False), ("table", "cable", False), ("window", "vvind0w", True)])
def test_confusions(true, read, yes):
    assert scans.misread_as(true, read) is yes
    if yes:
        assert scans.confusion_key(true) == scans.confusion_key(read)


@pytest.mark.parametrize("line,yes", [("12", True), ("- 7 -", True), ("Slide l9", True), ("Page 3 of 2O", True), ("xiv", True), ("p. 4", True), ("[10]", True), ("3.14", False), ("99 %", False), ("cil.", False), ("number 9.", False), ("mix", False), ("", False)])
def test_pages(line, yes):
    assert scans.is_page(line) is yes


def rows():
    body = ["Here we gather the sturdy notes about the", "river and the bridge."]
    out = []
    for i in range(8):
        head = ["Lesson 4 — the river of bridge", "LESSON 4 — THE RIVER OF BRIDGE", "esson 4 — the river of bridge", "Lesson  4 — thc river of bridge"][i % 4]
        out.append((i, "v", i * 500, "\n".join([head, *body, f"- {i + 3} -"]), False, "s", 1))
    return out


def found(spark, data):
    return {tuple(r) for r in scans.noisy_lines(spark.createDataFrame(data, SCHEMA)).collect()}


def test_heads_pages_cuts_and_misreads(spark):
    data = rows()
    data.append((20, "w", 0, "We see the bri-\ndge and the stur-\ndy notes.", None, "s", 1))
    data.append((21, "w", 100, "Notes about thc n0tes\nand nothing more -\nthan 404\n404\nnotes.", False, "s", 1))
    data.append((22, "w", 200, "def river(x1):\n    return x1[l0]\nbri-\ndge = 1;\n12", True, "s", 1))
    data += data[:3]
    got = found(spark, data)
    assert {(e, p) for e, p, n in got if n == "running_head"} == {(i, 0) for i in range(8)}
    assert {(e, p) for e, p, n in got if n == "page_number"} == {(i, 3) for i in range(8)}
    assert {(e, p) for e, p, n in got if n == "broken_word"} == {(20, 0), (20, 1)}
    assert {(e, p) for e, p, n in got if n == "misread"} == {(21, 0)}


def test_paragraphs(spark):
    data = [*rows(), (20, "w", 0, "We see the bri-\ndge and thc notes.", None, "s", 1), (21, "w", 0, "x = f(1);\ny = 2;", True, "s", 1)]
    got = {r["event_id"]: r for r in scans.clean_paragraphs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[0]["paragraphs"] == "Here we gather the sturdy notes about the river and the bridge."
    assert got[0]["removed_lines"] == 2
    assert got[20]["paragraphs"] == "We see the bridge and the notes."
    assert got[21]["paragraphs"] == "x = f(1);\ny = 2;"


def test_odd_rows(spark):
    assert found(spark, []) == set()
    data = [(1, None, None, None, None, None, None), (2, None, None, "", None, None, None), (3, None, None, "12", None, None, None), (None, "v", 1, "12", False, None, None), (4, None, 3, "a\n" * 5000, False, None, None)]
    assert found(spark, data) == {(3, 0, "page_number")}
    assert scans.clean_paragraphs(spark.createDataFrame(data, SCHEMA)).count() == 2


@pytest.mark.parametrize(
    "line,page",
    [("12", ("#", 12, False)), ("xiv", ("i", 14, False)), ("Slide l9", ("slide#", 19, True)), ("Page 3 of 2O", ("page# /#", 3, True)), ("- 7 -", ("-#-", 7, True)), ("ll", ("#", 11, False)), ("iii", ("i", 3, False)), ("§ 4", None), ("# 4", None), ("mix", None)],
)
def test_numbers_of_pages(line, page):
    assert scans.page_of(line) == page


def test_sequences_decide_bare_numbers(spark):
    body = "The old bridge crosses the river.\nWe see it."
    alone = [(1, "a", 0, f"2019\n{body}", False, "s", 1), (2, "b", 0, f"x\n{body}", False, "s", 1), (3, "c", 0, f"7\n{body}", False, "s", 1)]
    run = [(10 + i, "d", 500 * i, f"{n}\n{body}", False, "s", 1) for i, n in enumerate(("4", "2019", "6", "ix", "8"))]
    roman = [(20 + i, "e", 500 * i, f"{n}\n{body}", False, "s", 1) for i, n in enumerate(("ix", "x", "xii"))]
    got = {e for e, p, n in found(spark, alone + run + roman) if n == "page_number"}
    assert got == {3, 10, 12, 13, 14, 20, 21, 22}


def moved(data, frames):
    return [(e, v, f + frames, *rest) for e, v, f, *rest in data]


def test_frames_may_be_shifted(spark):
    data = []
    for chunk in range(6):
        for i in range(4):
            data.append((100 * chunk + i, "v", chunk * 7000 + i * 1500, f"Lesson {chunk} of the river course\nHere we gather the notes.\n{3 + i}", False, "s", 1))
    want = found(spark, data)
    assert {n for _, _, n in want} == {"running_head", "page_number"}
    for shift in (1, 9_999, 12_345, 29_000):
        assert found(spark, moved(data, shift)) == want
    cut = scans.head_and_page_lines(spark.createDataFrame(data, SCHEMA), range_frames=4_000)
    assert {tuple(r) for r in cut.collect()} == want


def test_heads_of_three_lines_and_events_without_frames(spark):
    body = "The old bridge crosses the river.\nWe see it."
    data = [(i, "v", 400 * i, f"Course on rivers and bridges\nLesson four of the course\nWater archive of the valley\n{body}", False, "s", 1) for i in range(4)]
    assert {(e, p) for e, p, n in found(spark, data) if n == "running_head"} == {(i, p) for i in range(4) for p in range(3)}
    assert found(spark, [(e, v, None, *rest) for e, v, f, *rest in data]) == set()
    timed = spark.createDataFrame([(e, v, None, *rest, f / 25) for e, v, f, *rest in data], f"{SCHEMA}, timestamp_s double")
    assert {tuple(r) for r in scans.noisy_lines(timed).collect()} == found(spark, data)


def test_counts_of_any_size_and_both_ways(spark, monkeypatch):
    """The same corpus ten times as large gives the same kinds of lines, and so does the way without a list on the executors."""
    data = [*rows(), (20, "w", 0, "We see the bri-\ndge and the well-\nknown notes about thc n0tes.", None, "s", 1)]
    data += [(30 + i, f"x{i}", 0, "The well is known for notes about the bridge. Known by the well.", None, "s", 1) for i in range(5)]
    many = [(e + 1000 * k, f"{v}{k}", *rest) for k in range(10) for e, v, *rest in data]
    want = found(spark, data)
    assert (20, 0, "broken_word") in want and (20, 1, "broken_word") not in want and (20, 2, "misread") in want
    assert {(e % 1000, p, n) for e, p, n in found(spark, many)} == want
    monkeypatch.setattr(scans, "BROADCAST_WORDS", 0)
    assert found(spark, data) == want


def test_long_words_need_less_frequency(spark):
    said = ["The raskomora stands by the modern river and the lid."] * 3 + ["The raskornora stands by the modem river and the licl."]
    data = [(i, f"v{i}", 0, t, False, "s", 1) for i, t in enumerate(said)]
    got = {(r["word"], r["fix"]) for r in scans.misread_words(scans.vocabulary(spark.createDataFrame(data, SCHEMA))).collect()}
    # three against one is enough for nine letters, not for three or six
    assert got == {("raskornora", "raskomora")}

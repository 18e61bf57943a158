import json
import random

from loomline.operators import nested

SCHEMA = "record_id bigint, record_kind string, payload string, parent_pos int, text string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "other") for r in rows], SCHEMA)


def keys(spark, rows, **kw):
    return {tuple(r) for r in nested.child_tables(table(spark, rows), keys_only=True, **kw).collect()}


def word(text, label="word"):
    return {"start": 1.0, "end": 2.0, label: text}


def test_layouts(spark):
    segments = [{"index": 0, "start": 0, "end": 1, "text": "a b", "words": [word("a"), None, word(" ", "text"), word("b", "text")]}, None, {"index": 2, "start": 1, "end": 2, "text": "c"}, {"index": 3, "start": 2, "end": 3, "text": "d", "words": word("d")}]
    want = {("word", 0, 0), ("word", 0, 3), ("word", 3, 0)}
    layouts = [
        segments, {"segments": segments}, {"res": {"segments": segments, "meta": {}}}, {"result": {"segments": json.dumps(segments)}}, {"transcript": {"segments": {str(i): s for i, s in enumerate(segments)}}},
        {"meta": {"language": "en"}, "chapters": [{"title": "x", "segments": segments[:2]}, {"title": None, "segments": segments[2:]}]},
        {"segments": [{**s, "words": json.dumps(s["words"])} if s and "words" in s else s for s in segments]},
    ]
    rows = [(i, "transcript", json.dumps(x)) for i, x in enumerate(layouts)]
    got = keys(spark, rows + rows[:2])
    for i in range(len(layouts)):
        assert {k[1:] for k in got if k[0] == i} == want, layouts[i]


def test_screen_layouts(spark):
    boxes = [{"text": "x", "confidence": 0.5, "bbox": [1, 2, 3, 4]}, {"text": None, "poly": [[5, 6], [9, 6], [9, 8], [5, 8]]}, {"text": "[7]", "confidence": "0.910", "poly": [[5, 6], [9, 6], [9, 8], [5, 8]]}, {"text": "z", "x1": 1, "y1": 2, "x2": 3, "y2": "4"}]
    event = {"event_id": 1, "timestamp": 2.5, "frame_index": 60, "text": "x", "lines": ["x"]}
    events = [{**event, "boxes": boxes}, {**event, "boxes": None}, {**event, "ocr": {"res": {"boxes": boxes[:1]}}}, {**event, "boxes": boxes[0]}, {**event, "boxes": json.dumps(boxes)}]
    layouts = [events, {"events": events}, {"ocr_events": events}, {"res": events}, {"video": {"fps": 25.0, "size": [1, 2]}, "data": {"events": events}}]
    got = {tuple(r[k] for k in ("record_id", "parent_pos", "child_pos")): r for r in nested.child_tables(table(spark, [(i, "ocr", json.dumps(x)) for i, x in enumerate(layouts)])).collect()}
    for i in range(len(layouts)):
        assert {k[1:] for k in got if k[0] == i} == {(0, 0), (0, 2), (0, 3), (2, 0), (3, 0), (4, 0), (4, 2), (4, 3)}
        a, b, c = got[i, 0, 0], got[i, 0, 2], got[i, 0, 3]
        assert (a["x1"], a["y2"], a["score"], a["variant"]) == (1, 4, 0.5, "bbox,confidence,text")
        assert (b["x1"], b["y1"], b["x2"], b["y2"], b["score"], b["text"]) == (5, 6, 9, 8, 0.91, "[7]") and c["y2"] == 4
    parents = nested.parent_table(table(spark, [(0, "ocr", json.dumps(events))])).collect()
    assert {(r["parent_pos"], r["n_children"], r["start"], r["frame_index"]) for r in parents} == {(0, 4, 2.5, 60), (1, 0, 2.5, 60), (2, 1, 2.5, 60), (3, 1, 2.5, 60), (4, 4, 2.5, 60)}


def test_odd_rows(spark):
    bad = ['{"segments": [', "", "null", "3", '"x"', "[]", "{}", '{"segments": NaN}', "[" * 100_000, '[{"words": [NaN]}]', None]
    rows = [(i, k, p) for i, p in enumerate(bad) for k in ("transcript", "ocr", None)]
    assert keys(spark, rows) == set() and keys(spark, []) == set()
    long = [{"index": 0, "start": 0, "text": "x", "words": [word(f"w{i}") for i in range(20_000)]}]
    assert len(keys(spark, [(1, "transcript", json.dumps(long))])) == 20_000
    assert keys(spark, [(1, None, json.dumps([{"words": ["a", " ", "b"], "start": 1}]))]) == {(1, "word", 0, 0), (1, "word", 0, 2)}


def test_automaton_ignores_label_order():
    rng = random.Random(1)
    automaton = nested.TreeAutomaton()
    for _ in range(20):
        items = list({"index": 0, "start": 1.0, "end": 2.0, "text": "x", "words": []}.items())
        rng.shuffle(items)
        assert automaton.state(dict(items)) == nested.SEGMENT
        assert automaton.state({"a": [dict(items)]}) == nested.WRAPPER
    assert automaton.state([[1, 2], [3, 4]]) == nested.POLYGON and automaton.state({"text": "x", "bbox": [1]}) == nested.PANEL


def test_states_come_from_the_children():
    automaton = nested.TreeAutomaton()
    spans = [{"text": "hi", "start": 1.0, "end": 2.0}]
    assert automaton.state({"start": 1.0, "tokens": spans}) == nested.SEGMENT and automaton.state({"start": 1.0, "tokens": [1, 2]}) == nested.OTHER
    assert automaton.subtype({"text": "x", "bbox": [1, 2, 3, 4]}) == "box_bbox" and automaton.subtype({"text": "x", "bbox": "none", "confidence": 0.5}) == "box_bare"
    assert automaton.subtype({"text": "x", "poly": [[1, 2], [3, 4]]}) == "box_poly" and automaton.subtype({"text": "x", "x1": 1, "y1": 2, "x2": "3", "y2": None}) == "box_corners"
    assert automaton.subtype({"word": "x", "start": "1"}) == "word_timed" and automaton.subtype({"word": "x", "start": [1]}) == "word_bare"


def test_typed_subtype_tables(spark, tmp_path):
    boxes = [{"text": "x", "confidence": 0.5, "bbox": [1, 2, 3, 4]}, {"text": "y", "poly": [[5, 6], [9, 8]]}, {"text": "z", "x1": 1, "y1": 2, "x2": 3, "y2": "4"}, "plain"]
    rows = table(spark, [(1, "ocr", json.dumps({"events": [{"timestamp": 1, "boxes": boxes}]})), (2, "transcript", json.dumps([{"index": 0, "start": 0, "words": [word("a"), "b"]}]))])
    tables = nested.subtype_tables(rows)
    assert {k: t.count() for k, t in tables.items()} == {"word_timed": 1, "word_bare": 1, "box_corners": 1, "box_bbox": 1, "box_poly": 1, "box_bare": 1}
    assert "x1" not in tables["word_timed"].columns and "start" not in tables["box_bbox"].columns
    nested.write_subtypes(rows, str(tmp_path / "t"))
    for k, t in tables.items():
        again = nested.read_subtype(spark, str(tmp_path / "t"), k)
        assert again.columns == t.columns and sorted(map(tuple, again.collect())) == sorted(map(tuple, t.collect()))
    # every child joins its parent by the supertype keys
    parents = nested.parent_table(rows)
    assert all(t.join(parents, ["record_id", "parent_pos"], "left_anti").count() == 0 for t in tables.values())


def test_lists_of_any_label_keep_their_parents(spark):
    record = {"segments": [{"index": 0, "start": 0, "text": "a b", "tokens": [{"token": "hi", "p": 0.5}, {"token": "ho", "alt": [{"token": "oh"}]}]}], "meta": {"speakers": [{"name": "x", "of": {"site": "y"}}], "n": 3}, "grid": [[1, 2], [3, 4]]}
    rows = {r["place"]: r for r in nested.object_table(table(spark, [(1, "transcript", json.dumps(record)), (1, "transcript", json.dumps(record)), (2, "ocr", "{broken"), (3, None, None), (4, None, "[[{\"a\": 1}]]")])).collect()}
    assert set(rows) == {"/segments:0", "/segments:0/tokens:0", "/segments:0/tokens:1", "/segments:0/tokens:1/alt:0", "/meta.speakers:0", "/:0/:0"}
    deep = rows["/segments:0/tokens:1/alt:0"]
    assert (deep["table"], deep["parent_table"], deep["parent_place"], deep["fields"]) == ("segments.tokens.alt", "segments.tokens", "/segments:0/tokens:1", {"token": "oh"})
    assert rows["/meta.speakers:0"]["fields"] == {"name": "x", "of.site": "y"} and rows["/segments:0/tokens:0"]["variant"] == "p,token"
    assert all(r["parent_place"] in {*rows, "", "/:0"} for r in rows.values())

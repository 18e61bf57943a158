import pytest

from loomline.llm import mixing

DOC = "doc_id bigint, text string, source string, lang string, n_tokens int"
MIX = "source_name string, target_share double, max_repeats int"


def measured(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_tokens bigint")


def mix(spark, rows):
    return spark.createDataFrame(rows, MIX)


def test_tokens_match_the_tokenizer(spark):
    import os

    if not os.path.exists(mixing.VOCABULARY):
        pytest.skip("no vocabulary file")
    texts = ["We see the river.", "नमस्ते दुनिया", "", None, "x" * 5000]
    frame = spark.createDataFrame([(i, t, " ASR-Small ", "en", 0) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in mixing.sizes(frame, None).collect()}
    encoder = mixing._encoder(mixing.VOCABULARY)
    assert [got[i]["n_tokens"] for i in range(5)] == [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]
    assert got[0]["source"] == "asr_small"
    for t in texts:
        assert not t or encoder.decode(encoder.encode_ordinary(t)) == t


def test_shortage_goes_to_siblings_first():
    leaf = lambda w, c: mixing.Node(w, c)
    a, b, c = leaf(0.4, 10), leaf(0.2, 100), leaf(0.4, 100)
    left = mixing.Node(0.6, 110, below={"a": a, "b": b})
    right = mixing.Node(0.4, 100, below={"c": c})
    root = mixing.Node(1.0, 210, below={"l": left, "r": right})
    assert mixing.allot(root, 100) == 0
    assert (a.budget, b.budget, c.budget) == (10, 50, 40)
    assert mixing.allot(root, 300) == pytest.approx(90) and (a.budget, b.budget, c.budget) == (10, 100, 100)


def test_draw_keeps_budgets_and_repeats(spark):
    rows = [(i, "big", "en", 10) for i in range(1000)] + [(2000 + i, "small", "de", 10) for i in range(20)] + [(3000, None, "en", 10), (3001, "other", "en", 10), (3002, "big", "en", 0)]
    wanted = mix(spark, [("big", 0.5, 1), ("small", 0.5, 4), ("none", 0.0, 2)])
    frame = measured(spark, rows)
    drawn = mixing.draw(frame, wanted, size=2000)
    got = {r["doc_id"]: r["repeats"] for r in drawn.collect()}
    assert all(got[2000 + i] == 4 for i in range(20)) and max(got[i] for i in got if i < 1000) == 1
    assert 1200 <= sum(10 * n for n in got.values()) <= 2020
    again = {r["doc_id"]: r["repeats"] for r in mixing.draw(frame.repartition(7), wanted, size=2000).collect()}
    assert got == again
    shares = {r["source_name"]: r for r in mixing.actual_shares(drawn, wanted).collect()}
    assert shares["small"]["mixed_tokens"] == 800 and shares["none"]["mixed_tokens"] == 0 and shares["small"]["most_repeats"] == 4


def test_whole_epochs_and_prefix(spark):
    frame = measured(spark, [(i, "a", "en", 1 + i % 3) for i in range(30)])
    total = sum(1 + i % 3 for i in range(30))
    got = [r["repeats"] for r in mixing.draw(frame, mix(spark, [("a", 1.0, 3)]), size=total * 2 + 20).collect()]
    assert set(got) == {2, 3} and len(got) == 30


def test_supply_and_odd_rows(spark):
    frame = measured(spark, [(1, "a", "en", 50), (2, "b", "en", 10), (3, None, "en", 40)])
    got = {r["source_name"]: r["stays_under"] for r in mixing.supply(frame, mix(spark, [("A", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9), ("d", None, None), (None, 0.1, 1)])).collect()}
    assert got == {"A": False, "b": True, "c": True, "d": False}
    empty = measured(spark, [])
    assert {r["stays_under"] for r in mixing.supply(empty, mix(spark, [("a", 0.5, 1)])).collect()} == {True}
    assert mixing.draw(empty, mix(spark, [("a", 0.5, 1)])).count() == 0
    assert mixing.draw(frame, mix(spark, [])).count() == 0


def test_budgeted_agrees_with_supply_and_plan(spark):
    frame = measured(spark, [(1, "a", "en", 30), (2, "b", "en", 10), (3, None, "en", 40), (4, "a", "de", 20)])
    wanted = mix(spark, [("A", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9), ("d", None, None), (None, 0.1, 1)])
    got = {r["source_name"]: r for r in mixing.budgeted(frame, wanted).collect()}
    assert {k: r["stays_under"] for k, r in got.items()} == {r["source_name"]: r["stays_under"] for r in mixing.supply(frame, wanted).collect()} == {"A": False, "b": True, "c": True, "d": False}
    assert (got["A"]["capacity"], got["b"]["capacity"], got["c"]["capacity"]) == (50, 20, 0)
    leaves = mixing.plan(frame, wanted)
    assert {(s, l) for s, l, *_ in leaves} == {("a", "en"), ("a", "de"), ("b", "en")}
    assert got["A"]["budget"] == pytest.approx(sum(x[4] for x in leaves if x[0] == "a"))
    assert mixing.budgeted(measured(spark, []), mix(spark, [("a", 0.5, 1)])).filter("stays_under").count() == 1
    assert mixing.budgeted(frame, mix(spark, [])).count() == 0


def test_found_reaches_the_budgets(spark, monkeypatch):
    from loomline.llm import queries

    frame, wanted = measured(spark, [(1, "a", "en", 30), (2, "b", "en", 10)]), mix(spark, [("a", 0.5, 1), ("b", 0.5, 1)])
    allotted = []
    monkeypatch.setattr(queries, "table", lambda spark, d, name: wanted)
    monkeypatch.setattr(queries, "_sizes", lambda spark, d: frame)
    monkeypatch.setattr(mixing, "allot", lambda node, amount, allot=mixing.allot: allotted.append(amount) or allot(node, amount))
    assert [r["source_name"] for r in queries.p7_found(spark, "").collect()] == ["b"] and allotted[0] == 40


def test_redistribution_is_reported(spark):
    frame = measured(spark, [(i, "asr_small", "en", 10) for i in range(10)] + [(100 + i, "asr_big", "en", 10) for i in range(100)] + [(300 + i, "notes", "en", 10) for i in range(90)])
    wanted = mix(spark, [("asr_small", 0.25, 2), ("asr_big", 0.25, 1), ("notes", 0.5, 2)])
    got = {r["source_name"]: r for r in mixing.redistribution(frame, wanted).collect()}
    # the small source's shortage of 300 goes to its sibling, nothing to the other domain
    assert {s: (r["domain"], r["target_tokens"], r["budget"], r["moved"]) for s, r in got.items()} == {"asr_small": ("speech", 500, 200, -300), "asr_big": ("speech", 500, 800, 300), "notes": ("notes", 1000, 1000, 0)}
    other = {r["source_name"]: r["budget"] for r in mixing.redistribution(frame, wanted, domains={"asr_small": "a", "asr_big": "b"}).collect()}
    assert other == {"asr_small": 200, "asr_big": 600, "notes": 1200}

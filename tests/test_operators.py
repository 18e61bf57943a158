import random

import pytest

from loomline.operators import boxes, captions, extractors, fusion, golden, quality, regions, search, sequence, state
from loomline.operators.sequence import similarity_of as similarity

OBS = "video string, seq bigint, timestamp double, text string, is_code boolean, confidence double"
SEG = "video string, seq bigint, start double, end double, text string"


def observations(spark, rows):
    return spark.createDataFrame([(*r, False, 0.9)[:6] for r in rows], OBS)


def test_fusion_orders_ties_by_source(spark):
    seg = spark.createDataFrame([("v", 1, 5.0, 8.0, "a"), ("v", 2, 1.0, None, "b")], SEG)
    obs = spark.createDataFrame([("v", 7, 5.0, "x", True, 0.5), ("v", 8, 0.5, "y", False, None)], OBS)
    line = fusion.order_timeline(fusion.fuse(fusion.speech_events(seg), fusion.screen_events(obs)))
    assert [(r["type"], r["seq"]) for r in line.collect()] == [("ocr", 8), ("speech", 2), ("speech", 1), ("code", 7)]
    ids = [r[0] for r in line.select(fusion.event_id()).collect()]
    assert len(set(ids)) == 4 and all(len(i) == 12 for i in ids)


@pytest.mark.parametrize("width", [3.0, 7.0, 1000.0])
def test_context_against_brute_force(spark, width):
    rng = random.Random(2)
    seg = [("v", i, s := rng.uniform(0, 100), s + rng.choice([0.5, 3, 40]), f"t{i}") for i in range(60)] + [("v", 99, 3.0, None, None)]
    obs = [("v", i, rng.uniform(0, 130), "x") for i in range(40)] + [("w", 77, 5.0, "x")]
    got = {r["seq"]: r["context"] for r in fusion.speech_context(observations(spark, obs), spark.createDataFrame(seg, SEG), 10.0, width).collect()}
    for _, seq, t, _ in obs:
        near = [i for v, i, s, e, _ in seg if seq != 77 and max(s, e if e is not None else s) >= t - 10 and s <= t + 10]
        pieces = [p for p in got[seq].split("[") if p]
        assert len(pieces) == len(near)
    assert got[77] == ""
    absurd = spark.createDataFrame([("v", 1, 0.0, 1e15, "x")], SEG)
    assert fusion.speech_context(observations(spark, []), absurd).count() == 0
    assert fusion.speech_context(observations(spark, obs), absurd).filter("context != ''").count() == 40


def test_previous_crosses_slices(spark):
    rng = random.Random(3)
    rows = [(v, k, rng.uniform(0, 500)) for v in "ab" for k in range(80)]
    frame = spark.createDataFrame(rows, "video string, seq bigint, t double")
    got = {(r["video"], r["seq"]): r["prev_seq"] for r in sequence.previous(frame, "video", ["t", "seq"], ["seq"], sequence.F.floor(sequence.F.col("t") / 20)).collect()}
    for v in "ab":
        ordered = [k for _, k in sorted((t, k) for w, k, t in rows if w == v)]
        assert [got[v, k] for k in ordered] == [None, *ordered[:-1]]


def keep_brute(rows, threshold, heartbeat):
    kept, state_ = [], {}
    for v, seq, t, text in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if len(text.strip()) < 4:
            continue
        at, last = state_.get(v, (None, None))
        if at is None or similarity(last, text) < threshold or t - at >= heartbeat:
            state_[v] = (t, text)
            kept.append((v, seq))
    return set(kept)


@pytest.mark.parametrize("seed", range(3))
def test_keep_changed_against_fold(spark, seed):
    rng = random.Random(seed)
    pool = ["hello world", "hello word", "hello old", "other text", "abc"]
    rows = []
    for v in "ab":
        t = 0.0
        for k in range(150):
            t += rng.choice([0.1, 0.5, 1.0, 5.0])
            rows.append((v, k, t, rng.choice(pool)))
    got = {(r["video"], r["seq"]) for r in sequence.keep_changed(observations(spark, rows), 0.8, 3.0, slice_s=7.0).collect()}
    assert got == keep_brute(rows, 0.8, 3.0)


def test_sampler_and_scenes(spark):
    frames = spark.createDataFrame([("v", i, i * 0.25, 0.0 if i < 20 else 1.0) for i in range(60)], "video string, seq bigint, timestamp double, value double")
    got = [r["timestamp"] for r in sequence.adaptive_sample(frames, threshold=0.5).orderBy("timestamp").collect()]
    assert got[:3] == [0.0, 0.5, 1.0] and all(b - a >= 0.24 for a, b in zip(got, got[1:]))
    shots = spark.createDataFrame([("v", i, float(i), [0.0, 0.0] if i < 3 else [1.0, 0.0]) for i in range(6)], "video string, seq bigint, timestamp double, signature array<double>")
    assert [(r["seq"], r["difference"]) for r in sequence.scene_changes(shots, frames_per_slice=2).orderBy("seq").collect()] == [(0, 1.0), (3, 0.5)]
    dark = spark.createDataFrame([(1, 2.0, 0.01), (2, 2.0, 0.5), (3, 50.0, 0.0)], "seq int, luma double, difference double")
    assert {r["seq"] for r in sequence.dark_frames_removed(dark).collect()} == {2, 3}


def test_search(spark):
    seg = spark.createDataFrame([("v", 1, 10.0, 12.0, "We use PostgreSQL here"), ("v", 2, 50.0, 51.0, None)], SEG)
    obs = spark.createDataFrame([("v", 3, 15.0, "DATABASE_URL=x", False, 0.5), ("v", 4, 20.0, "DATABASE_URL", True, 0.0)], OBS)
    line = fusion.fuse(fusion.speech_events(seg), fusion.screen_events(obs))
    count = lambda *a, **k: search.search(line, *a, **k).count()
    assert (count("postgresql"), count("postgresql", case_sensitive=True), count("DATABASE_URL"), count("database", types=["code"]), count("zzz"), count("")) == (1, 0, 2, 1, 0, 4)
    report = search.report_lines(search.search(line, "database")).orderBy("seq").collect()
    assert report[0]["header"] == "── v ──" and report[1]["header"] is None and report[0]["line"] == "  [00:15.000] OCR      | DATABASE_URL=x conf=0.500" and not report[1]["line"].endswith("000")
    assert search.with_fallback(line.filter("video = 'none'"), seg, obs, "database").count() == 2


def test_regions_diffs_and_votes(spark):
    text = "Welcome\nint a;\nint b;\n\nx = 1\nplain words\n  y = 2\n  z = 3"
    got = regions.code_regions(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc bigint, text string")).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"], r["indented"]) for r in got] == [(1, 2, False), (6, 7, True)]
    assert got[1]["text"] == "  y = 2\n  z = 3"
    assert regions.changed_lines("a\nb\nc", "a\nx\nc\nd") == (["x", "d"], ["b"])
    assert regions.changed_lines("a", "a\n++i") == ([], [])
    chain = regions.version_chain(spark.createDataFrame([("v", 1, 1.0, "a"), ("v", 2, 2.0, "a"), ("v", 3, 3.0, "a\nb"), ("v", 4, 4.0, "b")], "video string, seq bigint, timestamp double, text string"))
    assert [(r["seq"], r["change"]) for r in chain.orderBy("seq").collect()] == [(3, "addition"), (4, "deletion")]
    earlier = regions.F.array(*[regions.F.lit(x) for x in ("if ready:", "if ready:", "if ready")])
    vote = spark.range(1).select(regions.repair_by_vote(regions.F.lit("if ready"), earlier), regions.repair_by_vote(regions.F.lit("else"), earlier)).first()
    assert tuple(vote) == ("if ready:", "else")


def test_vote_round_trip(spark):
    F = regions.F
    text = "def go(x):\n    if ready:\n        pass\n    else:\n        go(1)"
    row = spark.createDataFrame([(text,)], "text string").select(regions.repair_by_vote(F.regexp_replace("text", r"(?m):$", ""), F.array("text"))).first()
    assert row[0] == text


def test_temporal_vote_reads_the_frames_before(spark, tmp_path):
    from loomline.plans import text as plans

    good, bad = "if ready:\n    go()", "if ready\n    go()"
    rows = [(1, "v", 55.0, good), (2, "v", 58.0, good), (3, "v", 61.0, bad), (4, "v", 61.0, good), (5, "w", 62.0, bad), (6, "v", 300.0, bad), (7, None, 60.0, bad), (8, "v", None, bad), (9, "v", None, None), (10, "v", 118.0, bad), (11, "v", 118.5, bad), (12, "v", 122.0, bad)]
    rows += rows[:1] * 3
    frame = spark.createDataFrame([(*r, True) for r in rows] + [(13, "v", 60.5, bad, False)], "event_id bigint, video_id string, timestamp_s double, text string, code_likelihood boolean")
    frame.write.parquet(str(tmp_path / "ocr_event.parquet"))
    got = {r["doc"]: r["repaired"] for r in plans.temporal_vote(spark, str(tmp_path)).collect()}
    # 3 has two good frames before it; 10 has 2, 4 and the unrepaired 3; 11 has 3, 4 and 10, of which one is good, so it stays
    assert {k for k, v in got.items() if v == good} == {1, 2, 3, 4, 10}
    assert set(got) == set(range(1, 13)) and got[9] is None
    earlier = {r["seq"]: len(r["earlier"]) for r in regions.with_earlier(frame.distinct().filter("code_likelihood").toDF("seq", "video", "timestamp", "text", "x")).collect()}
    assert earlier == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 3, 11: 3, 12: 2}


def report(spark, texts, facts=None, lp=-0.2):
    rows = spark.createDataFrame([(1, i, t, (lp, 0.1, 1.2)) for i, t in enumerate(texts)], "key bigint, seq bigint, text string, quality struct<avg_logprob: double, no_speech_prob: double, compression_ratio: double>")
    known = spark.createDataFrame([(1, *(facts or (None, None)))], "key bigint, language_probability double, duration double")
    return quality.report(rows, "key", known).first()


def test_quality(spark):
    good = [f"number {a} walks to the {b} house near river" for a, b in zip("abcdefgh", "stuvwxyz")]
    assert report(spark, good)["status"] == "passed" and not report(spark, good)["flags"]
    assert report(spark, ["ॐ"] * 30)["flags"] == ["extreme_token_repetition"]
    assert report(spark, ["। "] * 80)["status"] == "failed"
    assert report(spark, good, lp=-1.7)["flags"] == ["low_average_log_probability"]
    assert report(spark, good, (0.3, 600.0))["flags"] == ["very_low_transcript_density", "uncertain_language_detection"]
    short = report(spark, good, (0.9, 20.0))
    assert short["wpm"] is None and short["score"] == 100
    assert report(spark, [None, ""])["flags"] == ["no_recognizable_text"]


def test_source_choice_and_summary(spark):
    rows = [("a", "manual", "review_required", 60), ("a", "asr", "passed", 100), ("b", "automatic", "passed", 90), ("b", "asr", "passed", 100), ("c", "automatic", "review_required", 50), ("c", "asr", "review_required", 40), ("d", "automatic", "review_required", 40), ("d", "asr", "review_required", 40), ("e", "automatic", "failed", 0)]
    got = {r["key"]: (r["kind"], r["status"]) for r in quality.choose_source(spark.createDataFrame(rows, "key string, kind string, status string, score int")).collect()}
    assert got == {"a": ("manual", "review_required"), "b": ("automatic", "review_required"), "c": ("automatic", "review_required"), "d": ("asr", "review_required"), "e": ("automatic", "failed")}
    sums = quality.run_summary(spark.createDataFrame([("passed",), ("review_required",), ("skipped",)], "status string")).first()
    assert (sums["processed"], sums["exit_code"], sums["found"]) == (2, 2, 3)


def test_captions(spark):
    raw = "﻿WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\n<c>नमो</c> &amp; x\nनमो & x\n\n00:02.500 --> 00:04.000\nnew​ <00:00:03.000>line\n42\n\n00:04.000 --> 00:05.000\nNEW LINE\n\n00:09.000 --> 00:08.000\nlost"
    got = captions.parse_vtt(spark.createDataFrame([("d", raw), ("e", ""), ("f", "no cues")], "doc string, raw string")).collect()
    assert [(r["index"], r["start"], r["end"], r["text"]) for r in got] == [(0, 1.0, 2.5, "नमो & x"), (1, 2.5, 4.0, "new line")]
    tracks = [("a", "automatic", "hi", None), ("a", "manual", "hi", None), ("b", "automatic", "gu", None), ("c", "automatic", "hi", None), ("c", "automatic", "gu", None), ("d", "automatic", "en", None), ("d", "automatic", "hi-orig", None), ("e", "automatic", "en", "hi-IN"), ("e", "automatic", "hi", "hi-IN"), ("f", "manual", "xx", None)]
    chosen = {r["key"]: (r["kind"], r["track"]) for r in captions.choose_track(spark.createDataFrame(tracks, "key string, kind string, track string, declared string")).collect()}
    assert chosen == {"a": ("manual", "hi"), "b": ("automatic", "gu"), "d": ("automatic", "hi-orig"), "e": ("automatic", "hi")}
    entries = spark.createDataFrame([(1, 0), (2, None), (3, 7), (4, 4)], "position int, playlist_index int")
    assert [r["original_index"] for r in captions.playlist_entries(entries, 2, 7, 2).collect()] == [2, 4]
    with pytest.raises(ValueError):
        captions.playlist_entries(entries, 5, 2)
    seg = spark.createDataFrame([("v", 2, 2.0, 3.0, "b"), ("v", 1, 0.0, 1.5, " a ")], SEG)
    assert captions.render_srt(seg, "video").first()["document"] == "1\n00:00:00,000 --> 00:00:01,500\na\n\n2\n00:00:02,000 --> 00:00:03,000\nb\n"
    assert captions.render_vtt(seg, "video").first()["document"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\na\n")


def test_boxes(spark):
    page = [{"x1": 50, "y1": 0, "x2": 90, "y2": 10}, {"x1": 0, "y1": 2, "x2": 40, "y2": 12}, {"x1": 0, "y1": 30, "x2": 40, "y2": 40}]
    assert boxes.reading_order(page) == [1, 0, 2]
    passes = [(1, "original", 0.9, 10), (1, "clahe", 0.99, 99), (2, "original", 0.3, 10), (2, "clahe", 0.31, 10), (2, "sharpen", 0.5, 10), (3, "clahe", 0.5, 10), (4, "original", 0.0, 0)]
    got = {r["key"]: r["variant"] for r in boxes.best_variant(spark.createDataFrame(passes, "key int, variant string, confidence double, chars int")).collect()}
    assert got == {1: "original", 2: "sharpen", 3: "clahe", 4: "original"}
    poly = spark.createDataFrame([([[5.9, 2.0], [9.0, 2.5], [9.5, 8.0]],)], "p array<array<double>>").select(boxes.rectangle(boxes.F.col("p"))).first()[0]
    assert tuple(poly) == (5, 2, 9, 8)


def test_state(spark, tmp_path):
    videos = spark.createDataFrame([("a",), ("b",), ("c",)], "video string")
    known = spark.createDataFrame([("a", "ocr", "complete"), ("a", "ocr", "running"), ("b", "ocr", "partial")], "video string, stage string, status string")
    assert {r[0] for r in state.left_to_do(videos, known, "ocr").collect()} == {"b", "c"} and state.left_to_do(videos, known, "ocr", force=True).count() == 3
    got = {r["video"]: r["report"] for r in state.stage_report(videos, known).collect()}
    assert got["a"] == "metadata=pending transcription=pending ocr=complete fusion=pending output=pending" and "ocr=partial" in got["b"]
    (tmp_path / "x.mp4").write_bytes(b"a" * 9000)
    files = state.identities(spark.read.format("binaryFile").load(str(tmp_path / "x.mp4"))).withColumn("video", state.F.lit("x"))
    import hashlib

    assert files.first()["head_hash"] == hashlib.sha256(b"a" * 8192).hexdigest()[:16]
    assert state.changed(files, files).count() == 0 and state.changed(files, files.withColumn("size_bytes", state.F.lit(1))).count() == 1
    names = spark.createDataFrame([("v", "a.srt"), ("v", "b.vtt"), ("v", "a.vtt.part")], "video string, name string")
    assert state.pick_caption_file(names).first()["name"] == "b.vtt"


def test_registry(spark):
    r = extractors.Registry()
    seg = spark.createDataFrame([("v", 1, 1.0, 2.0, "a")], SEG)
    r.register(extractors.StreamExtractor("speech", lambda i: fusion.speech_events(i["segments"])))
    r.register(extractors.StreamExtractor("broken", lambda i: i["absent"]))
    r.register(extractors.StreamExtractor("away", lambda i: i["segments"], available=lambda: False))
    assert r.run_all({"segments": seg}).count() == 1 and len(r.enabled()) == 2
    r.disable("speech")
    with pytest.raises(ValueError):
        r.run_all({"segments": seg})
    with pytest.raises(KeyError):
        r.enable("nothing")


def test_golden_matches(spark):
    marks = spark.createDataFrame([("v", 1, 10.0, "code", "abcd"), ("v", 2, 50.0, "ocr", "x"), ("w", 3, 5.0, "ocr", "")], "video string, seq bigint, timestamp double, type string, text string")
    seen = spark.createDataFrame([("v", 7, 11.0, "code", "abxd"), ("v", 8, 12.0, "code", "abcd"), ("v", 9, 10.0, "ocr", "abcd"), ("v", 10, 70.0, "ocr", "x"), ("w", 11, 5.0, "ocr", "q")], "video string, seq bigint, timestamp double, type string, text string")
    got = {r["seq"]: (r["match"], r["time_error"], r["char_error_rate"]) for r in golden.match(marks, seen, 5.0).collect()}
    assert got == {1: (7, 1.0, 0.25), 2: (None, None, None), 3: (11, 0.0, None)}
    sums = golden.scores(golden.match(marks, seen, 5.0), seen).first()
    assert (sums["recall"], sums["precision"]) == (2 / 3, 2 / 5)


def test_versions_pass_over_nulls_and_keep_regions_apart(spark):
    kind = "video string, region_key string, seq bigint, timestamp double, text string"
    rows = [("v", "a", 1, 1.0, "a\nb"), ("v", "a", 2, 2.0, None), ("v", "a", 3, 3.0, "a\nc"), ("v", "b", 4, 2.5, "x"), ("v", "b", 5, 3.5, "x\ny"), ("v", None, 6, 9.0, "z"), ("v", "a", 7, None, "lost"), (None, "a", 8, 1.0, "q")]
    frame = spark.createDataFrame(rows, kind)
    got = {r["seq"]: (r["region_key"], r["previous_timestamp"], r["added"], r["removed"], r["change"]) for r in regions.version_chain(frame, slice_s=1.0).collect()}
    assert got == {3: ("a", 1.0, ["c"], ["b"], "modification"), 5: ("b", 2.5, ["y"], [], "addition")}
    every = {(r["video"], r["region_key"]): r for r in regions.evolutions(frame).collect()}
    assert every["v", "a"]["n_versions"] == 2 and every["v", "main"]["n_changes"] == 0 and every["v", "b"]["history"].endswith("(+1 -0)") and (None, "a") in every
    assert regions.version_chain(frame.limit(0)).count() == 0


def level_brute(boxes):
    """Lines of boxes by the rule as written: newest of the last five lines that is level."""
    lines = []
    for i in sorted(range(len(boxes)), key=lambda i: ((boxes[i]["y1"] + boxes[i]["y2"]) / 2, boxes[i]["x1"], i)):
        c, h = (boxes[i]["y1"] + boxes[i]["y2"]) / 2, max(1, boxes[i]["y2"] - boxes[i]["y1"])
        hits = [m for m in range(max(0, len(lines) - 5), len(lines)) if abs(c - sum(x[1] for x in lines[m]) / len(lines[m])) <= 0.6 * max(h, sum(x[2] for x in lines[m]) / len(lines[m]))]
        if hits:
            lines[hits[-1]].append((i, c, h))
        else:
            lines.append([(i, c, h)])
    return [x[0] for line in lines for x in sorted(line, key=lambda x: (boxes[x[0]]["x1"], x[0]))]


def test_reading_order_against_brute_force(spark):
    rng = random.Random(5)
    pages = []
    for k in range(40):
        boxes_ = [(x := rng.randrange(200), y := rng.randrange(60), x + 20, y + rng.randrange(0, 25)) for _ in range(rng.randrange(0, 14))]
        pages.append((k, boxes_))
    frame = spark.createDataFrame(pages + [(99, None), (98, [(1, None, 2, 3), (0, 0, 5, 5)])], "key bigint, boxes array<struct<x1: int, y1: int, x2: int, y2: int>>")
    got = {}
    for r in boxes.in_reading_order(frame).orderBy("key", "place").collect():
        got.setdefault(r["key"], []).append(r["box_pos"])
    for k, boxes_ in pages:
        assert got.get(k, []) == level_brute([dict(zip(("x1", "y1", "x2", "y2"), b)) for b in boxes_])
    assert got[98] == [1] and 99 not in got


def test_region_rectangles(spark):
    b = [(1, 2, 3, 4), (0, 5, 9, 9), (7, 1, 8, 2)]
    texts = spark.createDataFrame([(1, 0, 1), (1, 2, 9), (2, 0, 1), (1, 5, 6)], "doc bigint, start_line int, end_line int")
    frame = spark.createDataFrame([(1, b)], "doc bigint, boxes array<struct<x1: int, y1: int, x2: int, y2: int>>")
    got = {(r["doc"], r["start_line"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in regions.region_boxes(texts, frame).collect()}
    assert got == {(1, 0): (0, 2, 9, 9), (1, 2): (7, 1, 8, 2), (2, 0): (0, 0, 0, 0), (1, 5): (0, 0, 0, 0)}


def test_character_references(spark):
    import html
    from html.entities import html5

    from loomline.functions import text as text_

    rng = random.Random(1)
    cases = ["a &amp; b", "&lt;x&gt;", "&#39;&#x41;&#65 z", "&notit; &notin;", "&amp;amp;", "&", "&;", "&zzz;", "&#128;&#x80;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#11;", "&#1;", "&copy2024", "&ampx", "", "no"]
    cases += [f"x&{rng.choice(sorted(html5))}y" for _ in range(100)]
    got = spark.createDataFrame([(c,) for c in [*cases, None]], "t string").select("t", text_.unescaped("t").alias("u")).collect()
    assert [(r["t"], r["u"]) for r in got[:-1]] == [(c, html.unescape(c)) for c in cases] and got[-1]["u"] is None


def test_an_extractor_whose_tasks_fail(spark):
    r = extractors.Registry()
    seg = spark.createDataFrame([("v", 1, 1.0, 2.0, "a")], SEG)
    bad = lambda i: fusion.speech_events(i["segments"]).withColumn("text", extractors.fusion.F.raise_error(extractors.fusion.F.lit("no model")).cast("string"))
    r.register(extractors.StreamExtractor("speech", lambda i: fusion.speech_events(i["segments"])))
    r.register(extractors.StreamExtractor("failing", bad))
    assert [x["text"] for x in r.run_all({"segments": seg}).collect()] == ["a"]


def test_case_sensitive_search_reads_whole_texts(spark):
    seg = spark.createDataFrame([("v", 1, 10.0, 12.0, "x" * 300 + " Needle")], SEG)
    obs = observations(spark, [])
    none = fusion.speech_events(seg).limit(0)
    assert search.with_fallback(none, seg, obs, "Needle", case_sensitive=True).count() == 1 and search.with_fallback(none, seg, obs, "needle", case_sensitive=True).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_dense_videos_are_kept_slice_by_slice(spark, seed):
    """No gap in the whole video: slices depend on each other through the last kept row alone."""
    rng = random.Random(seed)
    pool = ["hello world", "hello word", "hello worlds", "hello old", "other text"] if seed % 2 else ["the same text"]
    rows, t = [], 0.0
    for k in range(400):
        t += rng.choice([0.1, 0.2, 0.7])
        rows.append((None if seed == 5 else "v", k, round(t, 3), rng.choice(pool)))
    rows += [("w", 1000 + k, 3.0 * k, "w text") for k in range(5)]
    got = {(r["video"], r["seq"]) for r in sequence.keep_changed(observations(spark, rows), 0.8, 3.0, slice_s=rng.choice([3.0, 5.0, 20.0])).collect()}
    assert got == keep_brute([(v or "", *rest) for v, *rest in rows], 0.8, 3.0) if seed != 5 else {(v or "", s) for v, s in got} == keep_brute([(v or "", *rest) for v, *rest in rows], 0.8, 3.0)
    with pytest.raises(ValueError):
        sequence.keep_changed(observations(spark, rows), heartbeat=9.0, slice_s=5.0)

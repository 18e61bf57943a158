import random

from loomline.llm.nearest import nearest_in_time

EVENT = "event_id bigint, video_id string, timestamp_s double, entity string, slot int"
SEGMENT = "segment_id bigint, video_id string, start_s double, end_s double, a string, id int"


def pairs(spark, events, segments, **kw):
    found = nearest_in_time(spark.createDataFrame(events, EVENT), spark.createDataFrame(segments, SEGMENT), **kw).collect()
    return {r["event_id"]: (r["segment_id"], round(r["distance"], 6)) for r in found}, len(found)


def brute(events, segments, tolerance=10.0):
    out = {}
    for e, v, t, *_ in events:
        if v is None or t is None:
            continue
        best = None
        for s, w, a, b, *_ in segments:
            if w != v or a is None:
                continue
            b = a if b is None or b < a else b
            d = max(0.0, a - t, t - b)
            if d <= tolerance and (best is None or d < best[1] - 1e-12):
                best = (s, d)
        if best:
            out[e] = (best[0], round(best[1], 6))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    segments = []
    for v in range(3):
        at = 0.0
        for k in range(120):
            at += rng.uniform(0.5, 40)
            end = rng.choice([at + rng.uniform(0.1, 8), at + rng.uniform(0.1, 8), None, at - 1])
            segments.append((v * 1000 + k, f"v{v}", at, end, "x", 0))
            at = max(at, end or at)
    segments += [(9000, "v0", None, 5.0, "x", 0), (9001, None, 5.0, 6.0, "x", 0)] + segments[:10]
    events = [(i, f"v{i % 4}", rng.uniform(0, 2500), "e", 1) for i in range(400)]
    events += [(1000, None, 5.0, "e", 1), (1001, "v0", None, "e", 1)] + events[:5]
    for width in (600.0, 30.0):
        got, n = pairs(spark, events, segments, range_s=width)
        assert n == len(got)
        assert got == brute(events, segments)


def test_ties_long_segments_and_not_a_number(spark):
    nan = float("nan")
    segments = [(1, "v", 0.0, 1.0, "x", 0), (2, "v", 5.0, 6.0, "x", 0), (3, "v", 5.0, 6.0, "x", 0), (4, "w", 0.0, 1e15, "x", 0), (5, "v", nan, 3.0, "x", 0)]
    events = [(1, "v", 3.0, "e", 1), (2, "v", 5.5, "e", 1), (3, "w", 1e6, "e", 1), (4, "v", nan, "e", 1), (5, "v", 16.0, "e", 1), (6, "v", 16.1, "e", 1)]
    got, _ = pairs(spark, events, segments)
    assert got == {1: (1, 2.0), 2: (2, 0.0), 3: (4, 0.0), 5: (2, 10.0)}


def test_empty_tables(spark):
    assert pairs(spark, [], [(1, "v", 0.0, 1.0, "x", 0), (2, "v", 0.0, 1e15, "x", 0)]) == ({}, 0)
    assert pairs(spark, [(1, "v", 0.0, "e", 1)], []) == ({}, 0)


def test_wide_segments_both_ways(spark):
    """Segments with absurd ends give the same pairs whether they are spread or joined with their entity's ranges."""
    rng = random.Random(11)
    segments = [(k, f"v{k % 3}", rng.uniform(0, 9000), None, "x", 0) for k in range(60)]
    segments = [(k, v, a, rng.choice([a + 3, a + 4000, a + 9000, 1e15]) if k % 5 == 0 else a + 3, x, i) for k, v, a, _, x, i in segments]
    events = [(k, f"v{k % 3}", rng.uniform(-50, 12_000), "x", 0) for k in range(200)] + [(900, "v0", 1e14, "x", 0), (901, "v9", 5.0, "x", 0)]
    want = brute(events, segments)
    lengths = {s: (b or a) - a for s, _, a, b, *_ in segments}
    for wide in (0.0, 7200.0):
        got, n = pairs(spark, events, segments, wide_s=wide)
        assert n == len(got) == len(want) and {e: d for e, (_, d) in got.items()} == {e: d for e, (_, d) in want.items()} and lengths

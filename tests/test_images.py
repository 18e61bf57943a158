import numpy as np
import pytest

from loomline.operators import images, sequence


def test_signature_and_difference():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (120, 200, 3), np.uint8), rng.integers(0, 256, (77, 133, 3), np.uint8)
    for f in (a, b, a[:, :, 0], np.zeros((1, 1, 3), np.uint8)):
        s = images.signature(f)
        assert s.shape == (54, 96) and s.dtype == np.float32 and 0 <= s.min() and s.max() <= 1
    sa, sb = images.signature(a), images.signature(b)
    assert images.difference(sa, sa) < 0.001 and images.difference(None, sa) == 1.0 and images.difference(sa, sb) == images.difference(sb, sa)
    black, white = np.zeros((60, 90, 3), np.uint8), np.full((60, 90, 3), 255, np.uint8)
    assert images.difference(images.signature(black), images.signature(white)) > 0.9
    flat = images.signature(np.full((61, 97, 3), 100, np.uint8))
    assert np.allclose(flat, 100 / 255, atol=1e-6)


def test_variants():
    ramp = np.tile(np.linspace(90, 110, 128), (64, 1)).astype(np.uint8)
    wide = images.prepare(ramp, "clahe")
    assert wide.shape == ramp.shape and int(wide.max()) - int(wide.min()) > 20
    edge = np.where(np.arange(64) < 32, 50, 200)[None, :].repeat(40, 0).astype(np.uint8)
    sharp = images.prepare(edge, "sharpen")
    assert sharp.min() < 50 and sharp.max() > 200
    page = np.full((80, 80), 230, np.uint8)
    page[40, 10:70] = 20
    ink = images.prepare(page, "threshold")
    assert set(np.unique(ink)) == {0, 255} and (ink[40, 10:70] == 0).all() and ink[5, 5] == 255
    with pytest.raises(ValueError):
        images.prepare(page, "blur")


def test_scenes_from_frames(spark):
    black, white = bytes(30 * 40 * 3), b"\xff" * (30 * 40 * 3)
    rows = [("v", i, float(i), 30, 40, bytearray(p)) for i, p in enumerate([black, black, white, white])] + [("v", 9, 9.0, 30, 40, None)]
    frames = images.frame_signatures(spark.createDataFrame(rows, "video string, seq bigint, timestamp double, height int, width int, pixels binary"))
    assert [r["seq"] for r in sequence.scene_changes(frames).orderBy("seq").collect()] == [0, 2]
    assert {round(r["luma"]) for r in frames.collect()} == {0, 255}


def test_activity_episodes(spark):
    from loomline.streaming.stateful import activity_episodes

    rows = spark.createDataFrame([("v", s) for s in (0, 3, 9, 30, 33)] + [("w", 1)], "video string, s int").selectExpr("video", "timestamp_seconds(s) as at")
    assert sorted((r["video"], r["n_changes"]) for r in activity_episodes(rows, "at").collect()) == [("v", 2), ("v", 3), ("w", 1)]


def test_enhanced_frames(spark):
    rows = [("v", 1, 8, 40, bytearray(range(256)) + bytearray(704)), ("v", 2, 8, 40, None)]
    frame = spark.createDataFrame(rows, "video string, seq bigint, height int, width int, pixels binary")
    got = {r["variant"]: r for r in images.enhanced_frames(frame, ("original", "sharpen", "threshold", "clahe")).collect()}
    assert {k: len(r["pixels"]) for k, r in got.items()} == {"original": 960, "sharpen": 320, "threshold": 320, "clahe": 320}
    assert bytes(got["sharpen"]["pixels"]) == images.prepare(images.as_frame(8, 40, bytes(rows[0][4])), "sharpen").tobytes()
    with pytest.raises(ValueError):
        images.enhanced_frames(frame, ("blur",))


def test_sampler_on_signatures_until_the_end(spark):
    rows = [("v", i, i * 0.25, [0.0, 0.0] if i < 20 else [1.0, 0.0], 9.0) for i in range(60)]
    frame = spark.createDataFrame(rows, "video string, seq bigint, timestamp double, value array<double>, duration double")
    got = sequence.adaptive_sample(frame, threshold=0.4).orderBy("timestamp").collect()
    plain = sequence.adaptive_sample(frame.selectExpr("video", "seq", "timestamp", "value[0] / 2 as value"), threshold=0.4).orderBy("timestamp").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in plain if r["timestamp"] <= got[-1]["timestamp"]] and got[-1]["timestamp"] >= 9.0 and got[-2]["timestamp"] < 9.0

import json

import pytest

from loomline import cli
from loomline.config import PRESETS, load_config, preset
from loomline.sources import readers, writers


@pytest.fixture()
def folder(tmp_path):
    a, b = tmp_path / "in" / "alpha", tmp_path / "in" / "beta"
    a.mkdir(parents=True), b.mkdir()
    seg = {"segments": [{"index": 0, "start": 1.0, "end": 3.0, "text": " Hello  world ", "words": []}, {"index": 1, "start": 4.0, "end": 5.0, "text": " "}, {"index": 2, "start": 6.0, "end": 7.5, "text": "bye", "extra": 1}], "meta": {"model": "small"}}
    (a / "transcript.json").write_text(json.dumps(seg, indent=1))
    events = [{"event_id": i, "timestamp": 1.0 + i, "frame_index": i, "text": t, "code_likelihood": False, "mean_confidence": 0.5} for i, t in enumerate(["Title page", "Title page", "const server = 1;"])]
    (a / "ocr_events.json").write_text(json.dumps(events))
    (b / "timeline.json").write_text(json.dumps([{"id": "x", "timestamp": 2.0, "type": "code", "source": "s", "text": "server.start()", "metadata": {"a": "1"}}]))
    (b / "transcript.json").write_text("{broken")
    (b / "c.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhi there\n")
    return tmp_path


def test_readers(spark, folder):
    seg = readers.read_transcripts(spark, str(folder / "in" / "alpha" / "transcript.json")).orderBy("seq").collect()
    assert [(r["video"], r["seq"], r["text"]) for r in seg] == [("alpha", 0, "Hello world"), ("alpha", 1, "bye")]
    assert readers.read_transcripts(spark, str(folder / "in" / "beta" / "transcript.json")).count() == 0
    assert readers.read_vtt(spark, str(folder / "in" / "beta" / "c.vtt")).first()["text"] == "hi there"
    (folder / "in" / "alpha" / "A.MP4").write_bytes(b"x")
    (folder / "in" / "out").mkdir()
    (folder / "in" / "out" / "b.mp4").write_bytes(b"y")
    assert [r["path"][-5:] for r in readers.find_videos(spark, str(folder / "in"), "out").select("path").collect()] == ["A.MP4"]


def test_models_fail_per_file(spark):
    media = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")

    def model(content):
        if content == b"2":
            raise RuntimeError("no device")
        return [{"start": 0.0, "end": 1.0, "text": " x  y "}, {"text": " "}]

    got = {r["path"]: r for r in readers.recognize(media, model).collect()}
    assert got["a"]["text"] == "x y" and got["b"]["error"] == "RuntimeError: no device"
    assert {r["text"] for r in readers.recognize(media, model, lambda c: [{"text": "spare"}]).collect()} == {"x y", "spare"}


def test_command_line(spark, folder, capsys):
    out = str(folder / "out")
    assert cli.main(["run", str(folder / "in"), out, "--preset", "meeting", "--formats", "md,srt,html,json"]) in (0, 2)
    assert cli.main(["status", out]) == 0
    said = capsys.readouterr().out
    assert "alpha metadata=pending transcription=complete ocr=complete fusion=complete output=complete" in said
    timeline = spark.read.parquet(f"{out}/timeline")
    assert timeline.filter("type = 'speech'").count() == 2 and timeline.filter("type = 'ocr'").count() == 2
    for kind in ("md", "srt", "vtt", "html", "json"):
        assert spark.read.text(f"{out}/documents/{kind}").count() > 0
    assert cli.main(["search", str(folder / "in"), "server"]) == 0
    said = capsys.readouterr().out
    assert "── alpha ──" in said and "── beta ──" in said and "server.start()" in said
    assert cli.main(["search", str(folder / "in"), "server", "--type", "speech"]) == 0
    assert "No results" in capsys.readouterr().out
    assert cli.main(["captions", str(folder / "in"), out]) == 0


def test_writers(spark, tmp_path):
    seg = spark.createDataFrame([("v", 1, 0.0, 1.0, "नमस्ते")], "video string, seq bigint, start double, end double, text string")
    writers.write_documents(writers.transcript_documents(seg, ["video"]), str(tmp_path / "j"), ["video"])
    raw = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "j"), wholetext=True).select("value").collect())
    assert json.loads(raw)["segments"][0]["text"] == "नमस्ते"
    writers.write_json_lines(seg, str(tmp_path / "l"), append=True)
    writers.write_json_lines(seg, str(tmp_path / "l"), append=True)
    assert spark.read.json(str(tmp_path / "l")).count() == 2


def test_config(tmp_path):
    assert preset("coding").sample_interval == 1.5 and len(PRESETS) == 5
    with pytest.raises(ValueError):
        preset("absent")
    f = tmp_path / "c.yaml"
    f.write_text("sample_interval: 9  # slow\noutput_formats:\n  - md\n  - srt\nunknown: 1\nlanguage: null\nmin_ocr_chars: 7\n")
    c = load_config(str(f))
    assert (c.sample_interval, c.output_formats, c.min_ocr_chars, c.language) == (9, ("md", "srt"), 7, None)


def test_stages_resume(spark, folder):
    out, source = str(folder / "out"), str(folder / "in")
    assert cli.main(["run", source, out]) in (0, 2)
    mark = lambda: {r["video"]: (r["report"]) for r in cli.state.stage_report(readers.read_states(spark, f"{out}/state").select("video"), readers.read_states(spark, f"{out}/state")).collect()}
    files = lambda: sorted(str(p) for p in (folder / "out" / "timeline").rglob("*.parquet"))
    first = files()
    assert "output=complete" in mark()["alpha"]
    cli.main(["run", source, out])
    assert files() == first  # nothing is left to do
    cli.main(["run", source, out, "--force"])
    assert files() != first
    # a recording that changed is run again, the others aren't
    gamma = folder / "in" / "gamma"
    gamma.mkdir()
    (gamma / "transcript.json").write_text(json.dumps({"segments": [{"start": 1.0, "end": 2.0, "text": "new one"}]}))
    before = files()
    cli.main(["run", source, out])
    assert set(before) < set(files()) and any("gamma" in f for f in files())
    (gamma / "transcript.json").write_text(json.dumps({"segments": [{"start": 1.0, "end": 2.0, "text": "changed one"}, {"start": 3.0, "end": 4.0, "text": "more"}]}))
    cli.main(["run", source, out])
    assert set(before) < set(files())
    assert spark.read.parquet(f"{out}/timeline").filter("video = 'gamma' AND type = 'speech'").count() == 2
    assert spark.read.text(f"{out}/reports/videos").count() > 0


def test_a_failing_stage_is_partial(spark, folder, monkeypatch):
    out, source = str(folder / "out"), str(folder / "in")

    def broken(*a, **k):
        raise RuntimeError("no disk")

    monkeypatch.setattr(cli.writers, "render", broken)
    with pytest.raises(RuntimeError):
        cli.main(["run", source, out])
    monkeypatch.undo()
    states = {(r["video"], r["stage"]): r["status"] for r in readers.read_states(spark, f"{out}/state").collect()}
    assert states["alpha", "output"] == "partial" and states["alpha", "fusion"] == "complete"
    assert cli.main(["run", source, out]) in (0, 2)
    states = {(r["video"], r["stage"]): r["status"] for r in readers.read_states(spark, f"{out}/state").collect()}
    assert states["alpha", "output"] == "complete"
    assert readers.read_states(spark, str(folder / "nowhere")).count() == 0


GOOD = ["the river runs below the old bridge near town", "every teacher keeps notes about lessons and rivers", "we walk along quiet paths to see many birds"]


def collection_folder(tmp_path):
    base = tmp_path / "list"
    base.mkdir()
    entries = [{"id": f"v{i}", "title": f"Talk {i}", "playlist_index": i, "url": f"v{i}"} for i in range(1, 6)] + [None]
    (base / "playlist.json").write_text(json.dumps({"id": "PL1", "title": "My Talks!", "entries": entries}))
    cues = lambda texts: "WEBVTT\n\n" + "\n".join(f"00:00:{i:02d}.000 --> 00:00:{i + 1:02d}.000\n{t}\n" for i, t in enumerate(texts))
    speech = lambda texts: json.dumps({"segments": [{"start": float(i), "end": i + 1.0, "text": t} for i, t in enumerate(texts)], "meta": {"language": "en"}})
    plans = {"v1": ("manual", "en", GOOD, None), "v2": ("automatic", "en", GOOD, ["ha"] * 40), "v3": (None, None, None, GOOD), "v4": ("manual", "en", ["la " * 20], GOOD)}
    for video, (kind, track, texts, spoken) in plans.items():
        d = base / video
        d.mkdir()
        info = {"id": video, "title": f"Title of {video}", "duration": 60.0, "language": "en"}
        if kind:
            info["subtitles" if kind == "manual" else "automatic_captions"] = {track: [{"ext": "vtt", "url": "x"}]}
            (d / f"{kind}.{track}.vtt").write_text(cues(texts))
        (d / "info.json").write_text(json.dumps(info))
        if spoken:
            (d / "transcript.json").write_text(speech(spoken))
    return base


def test_collection_end_to_end(spark, tmp_path):
    base, out = collection_folder(tmp_path), tmp_path / "out"
    assert cli.main(["youtube-transcribe", str(base), str(out)]) == 1  # v5 has nothing at all
    root = out / "my-talks"
    meta = {r["video"]: r for r in spark.read.json(str(root / "metadata")).collect()}
    assert {v: (r["transcription_source"], r["status"]) for v, r in meta.items()} == {
        "v1": ("caption_manual", "passed"), "v2": ("caption_automatic", "review_required"), "v3": ("speech", "passed"), "v4": ("caption_manual", "review_required"), "v5": (None, "failed"),
    }
    assert meta["v2"]["flags"] == ["automatic_captions_not_human_verified"] and meta["v1"]["detected_language_name"] == "English" and meta["v3"]["model"] == "medium" and meta["v1"]["title"] == "Title of v1"
    index = "\n".join(r[0] for r in spark.read.text(str(root / "playlist_index")).collect())
    assert index.startswith("# my-talks") and index.index("Title of v1") < index.index("Title of v4") and "| failed |" in index
    sums = spark.read.json(str(root / "run_summary")).first()
    assert (sums["found"], sums["completed"], sums["review"], sums["failed"], sums["skipped"], sums["exit_code"]) == (5, 2, 2, 1, 0, 1)
    for kind in ("md", "srt", "vtt", "json"):
        assert spark.read.text(str(root / "transcripts" / kind)).filter("video = 'v3'").count() > 0
    # passed ones aren't done again, unless the request differs or it is forced
    cli.main(["youtube-transcribe", str(base), str(out), "--max-videos", "4"])
    sums = spark.read.json(str(root / "run_summary")).first()
    assert (sums["found"], sums["skipped"], sums["review"], sums["exit_code"]) == (4, 2, 2, 2)
    cli.main(["youtube-transcribe", str(base), str(out), "--max-videos", "4", "--force"])
    assert spark.read.json(str(root / "run_summary")).first()["skipped"] == 0
    cli.main(["youtube-transcribe", str(base), str(out), "--captions", "off", "--playlist-start", "3", "--playlist-end", "4"])
    meta = {r["video"]: r["transcription_source"] for r in spark.read.json(str(root / "metadata")).collect()}
    assert meta["v3"] == meta["v4"] == "speech" and meta["v1"] == "caption_manual"
    with pytest.raises(ValueError):
        cli.main(["youtube-transcribe", str(base), str(out), "--playlist-start", "9"])


def test_screen_text_models(spark):
    media = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "path string, content binary")

    def model(content):
        if content == b"2":
            raise RuntimeError("no device")
        if content == b"3":
            return {"res": {"rec_texts": ["low", "high"], "rec_polys": [[[0, 50], [9, 50], [9, 60], [0, 60]], [[0.0, 1.9], [9, 2], [9, 9], [0, 9]]]}}
        return {"rec_texts": [" right ", "", "left", "none"], "rec_scores": [0.5, 0.9], "rec_boxes": [[50, 0, 90, 10], [1, 1, 2, 2], [0, 2, 40, 12]]}

    got = {r["path"]: r for r in readers.recognize_boxes(media, model).collect()}
    assert [(b["text"], b["confidence"], b["x1"]) for b in got["a"]["boxes"]] == [("left", 1.0, 0), ("none", 1.0, 0), ("right", 0.5, 50)]
    assert got["b"]["error"] == "RuntimeError: no device" and got["b"]["boxes"] is None
    assert got["c"]["text"] == "high\nlow" and tuple(got["c"]["boxes"][0])[2:] == (0, 1, 9, 9) and got["c"]["mean_confidence"] == 1.0


def test_speech_models_give_words_and_what_they_know(spark):
    media = spark.createDataFrame([("a", bytearray(b"1"))], "path string, content binary")
    words = [{"start": "0.5", "end": 1, "word": "hi", "probability": "bad"}, {"word": None}]
    model = lambda content: ([{"start": 0.0, "end": 1.0, "text": "hi", "words": words, "quality": {"avg_logprob": -0.5, "seek": 3}}], {"language": "en", "duration": 1.0})
    r = readers.recognize(media, model).first()
    assert [tuple(w) for w in r["words"]] == [(0.5, 1.0, "hi", None), (None, None, "", None)]
    assert r["quality"]["avg_logprob"] == -0.5 and r["quality"]["seek"] == 3 and r["meta"] == {"language": "en", "duration": "1.0"}


def test_frames(spark, tmp_path):
    from loomline.sources import frames

    media = spark.createDataFrame([("a", bytearray(b"3")), ("b", bytearray(b"x"))], "path string, content binary")

    def decoder(content):
        n = int(content)

        def pictures():
            for k in range(n):
                yield 1, 2, bytes([k] * 6)
            raise EOFError("cut")

        return 0.0, pictures()

    got = frames.read_frames(media, decoder).collect()
    assert [(r["frame_index"], round(r["timestamp"], 4)) for r in got if r["path"] == "a" and not r["error"]] == [(0, 0.0), (1, 0.0333), (2, 0.0667)]
    assert sum(r["error"] is not None for r in got) == 2
    videos = spark.createDataFrame([("a", 5, 2.0, 9.0), ("b", 0, 2.0, 9.0), ("c", 40, -1.0, None), ("d", 4, None, -3.0)], "video string, frames bigint, fps double, probed double")
    F = readers.F
    assert [r[0] for r in videos.select(frames.duration_s(F.col("frames"), F.col("fps"), F.col("probed"))).collect()] == [2.5, 9.0, 0.0, 0.0]
    assert frames.frame_times(videos).count() == 49
    assert {(r["video"], r["frame_index"]) for r in frames.sampled_for_scenes(videos).collect()} == {("a", k) for k in range(5)} | {("c", 14), ("c", 29)}
    shots = frames.read_frames(media.filter("path = 'a'"), decoder).filter("error IS NULL").withColumn("name", readers.boxes_of.evidence_name(F.col("frame_index"), F.col("timestamp")))
    written = frames.write_evidence(shots, str(tmp_path / "evidence"), lambda h, w, p: p).collect()
    assert sorted(r["name"] for r in written) == ["000000_00000000.000s.jpg", "000001_00000000.033s.jpg", "000002_00000000.067s.jpg"]
    assert (tmp_path / "evidence" / "000002_00000000.067s.jpg").read_bytes() == bytes([2] * 6)


def test_commands_run_their_own_stage(spark, folder):
    out, source = folder / "own", str(folder / "in")
    assert cli.main(["transcribe", source, str(out)]) in (0, 2)
    assert (out / "quality").exists() and not (out / "screen").exists() and not (out / "timeline").exists()
    assert cli.main(["export", source, str(out)]) == 0  # without the screen stage, every screen event is exported
    assert spark.read.parquet(str(out / "timeline")).filter("type != 'speech'").count() == 3 and not (out / "screen").exists()
    assert cli.main(["ocr", source, str(out)]) == 0 and spark.read.parquet(str(out / "screen")).count() == 2
    assert cli.main(["export", source, str(out), "--force"]) == 0
    assert spark.read.parquet(str(out / "timeline")).filter("type != 'speech'").count() == 2
    assert cli.main(["run", str(folder / "nothing"), str(folder / "none")]) == 1

"""Frames of recordings: what a probe says of them, when each frame is shown, and pixels from any decoder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The frame rate of a recording whose own is unknown.
DEFAULT_FPS = 30.0


def duration_s(frames: Column, fps: Column, probed: Column) -> Column:
    """Frames by rate where both are known, else what the container says if that is positive, else 0."""
    return F.when((frames > 0) & (fps > 0), frames / fps).when(probed > 0, probed.cast("double")).otherwise(0.0)


def frame_rate(fps: Column) -> Column:
    return F.when(fps > 0, fps.cast("double")).otherwise(DEFAULT_FPS)


def frame_times(videos: DataFrame) -> DataFrame:
    """(video, frame_index, timestamp) of every frame of (video, frames, fps); no frames, no rows."""
    rows = videos.filter("frames > 0").select("video", frame_rate(F.col("fps")).alias("fps"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames").cast("bigint") - 1)).alias("frame_index"))
    return rows.select("video", "frame_index", (F.col("frame_index") / F.col("fps")).alias("timestamp"))


def sampled_for_scenes(videos: DataFrame) -> DataFrame:
    """The frames that scene detection looks at, two a second: of frames counted from 1, each whose count is a multiple of half the
    rate, cut to whole frames."""
    step = F.greatest(F.lit(1), F.floor(frame_rate(F.col("fps")) * 0.5)).cast("bigint")
    times = frame_times(videos).join(videos.select("video", step.alias("step")), "video")
    return times.filter((F.col("frame_index") + 1) % F.col("step") == 0).select("video", "frame_index", "timestamp")


def read_frames(media: DataFrame, decoder: Callable[[bytes], tuple[float, Iterable[tuple[int, int, bytes]]]]) -> DataFrame:
    """(path, frame_index, timestamp, height, width, pixels, error) of (path, content): a decoder gives the rate and the frames.

    Frames pass through one by one; a file that can't be decoded, or breaks off, gives a row with the error after its good frames.
    """
    schema = pa.schema([("path", pa.string()), ("frame_index", pa.int64()), ("timestamp", pa.float64()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def frames_of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            fps, frames = decoder(content)
            rate = fps if fps and fps > 0 else DEFAULT_FPS
            for i, (height, width, pixels) in enumerate(frames):
                yield path, i, i / rate, height, width, pixels, None
        except Exception as problem:  # noqa: BLE001 - any failure of a foreign decoder is one file's failure
            yield path, None, None, None, None, None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                held: list[tuple] = []
                for row in frames_of(path, content):
                    held.append(row)
                    if len(held) >= 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return media.select("path", "content").mapInArrow(run, "path string, frame_index bigint, timestamp double, height int, width int, pixels binary, error string")


def write_evidence(frames: DataFrame, folder: str, encode: Callable[[int, int, bytes], bytes]) -> DataFrame:
    """Write (name, height, width, pixels) as files of the shared ``folder`` and return (name, path, error).

    A file is written under another name and then moved, so a task that runs again leaves whole files only.
    """
    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for name, height, width, pixels in zip(*(batch.column(c).to_pylist() for c in ("name", "height", "width", "pixels"))):
                path, error = f"{folder}/{name}", None
                try:
                    with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                        f.write(encode(height, width, pixels))
                    os.replace(f.name, path)
                except Exception as problem:  # noqa: BLE001 - one picture's failure
                    error = f"{type(problem).__name__}: {problem}"
                rows.append({"name": name, "path": None if error else path, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return frames.select("name", "height", "width", "pixels").mapInArrow(run, "name string, path string, error string")

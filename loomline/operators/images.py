"""Frames as arrays: signature, brightness and the enhanced variants that weak text passes are retried on.

A frame is (height, width, pixels): 8-bit rows of three channels in binary. Decoding media is a source's task. Everything
is numpy over whole frames, called once per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE_HEIGHT, SIGNATURE_WIDTH = 54, 96


def gray(frame: np.ndarray) -> np.ndarray:
    """Luma of a blue-green-red frame, 0 to 255; a frame of one channel is its own."""
    return frame.astype(np.float64) if frame.ndim == 2 else frame.astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def _shrink(image: np.ndarray, n: int) -> np.ndarray:
    """Area-weighted means of the rows in n equal parts, from running sums."""
    size = image.shape[0]
    edges = np.linspace(0, size, n + 1)
    sums = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0)])
    low = np.minimum(edges.astype(int), size - 1)
    at = sums[low] + (edges - low)[:, None] * image[low]
    return (at[1:] - at[:-1]) / (size / n)


def _smooth(image: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian with mirrored borders."""
    for axis in (0, 1):
        pad = [(1, 1) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(image, pad, mode="reflect" if image.shape[axis] > 1 else "edge")
        image = (np.take(p, range(0, image.shape[axis]), axis) + 2 * image + np.take(p, range(2, image.shape[axis] + 2), axis)) / 4
    return image


def signature(frame: np.ndarray) -> np.ndarray:
    """54 x 96 smoothed luma in 0 to 1."""
    small = _shrink(_shrink(gray(frame), SIGNATURE_HEIGHT).T, SIGNATURE_WIDTH).T
    return np.clip(_smooth(small) / 255, 0, 1).astype(np.float32)


def difference(a: np.ndarray | None, b: np.ndarray | None) -> float:
    return 1.0 if a is None or b is None else float(np.abs(a.astype(np.float64) - b).mean())


def equalized(frame: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalisation of the luma: clipped histograms of tiles, interpolated between their centres."""
    image = np.clip(np.rint(gray(frame)), 0, 255).astype(np.int64)
    h, w = image.shape
    rows, cols = np.minimum(np.arange(h) * tiles // h, tiles - 1), np.minimum(np.arange(w) * tiles // w, tiles - 1)
    counts = np.zeros((tiles * tiles, 256))
    np.add.at(counts, ((rows[:, None] * tiles + cols[None, :]), image), 1)
    area = np.maximum(counts.sum(1, keepdims=True), 1)
    top = np.maximum(1, limit * area / 256)
    excess = np.maximum(counts - top, 0).sum(1, keepdims=True)
    maps = np.cumsum(np.minimum(counts, top) + excess / 256, axis=1) / area * 255
    y, x = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    value = lambda r, c: maps[r[:, None] * tiles + c[None, :], image]
    out = (1 - fy) * ((1 - fx) * value(y0, x0) + fx * value(y0, x1)) + fy * ((1 - fx) * value(y1, x0) + fx * value(y1, x1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def sharpened(frame: np.ndarray) -> np.ndarray:
    """Luma plus half of what smoothing takes away."""
    g = gray(frame)
    return np.clip(np.rint(1.5 * g - 0.5 * _smooth(_smooth(g))), 0, 255).astype(np.uint8)


def thresholded(frame: np.ndarray, block: int = 31, offset: float = 11.0) -> np.ndarray:
    """White where the luma is above its neighbourhood's mean less the offset, else black."""
    g = gray(frame)
    r = block // 2
    p = np.pad(g, r, mode="edge")
    sums = np.pad(np.cumsum(np.cumsum(p, 0), 1), ((1, 0), (1, 0)))
    mean = (sums[block:, block:] - sums[:-block, block:] - sums[block:, :-block] + sums[:-block, :-block]) / block**2
    return np.where(g > mean - offset, 255, 0).astype(np.uint8)


VARIANTS = {"original": lambda f: f, "clahe": equalized, "sharpen": sharpened, "threshold": thresholded}


def prepare(frame: np.ndarray, variant: str) -> np.ndarray:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    return VARIANTS[variant](frame)


def as_frame(height: int, width: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, -1).squeeze()


def frame_signatures(frames: DataFrame) -> DataFrame:
    """(video, seq, timestamp, signature, luma) of (video, seq, timestamp, height, width, pixels); frames without pixels are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [as_frame(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "pixels")))]
            signatures = pa.array([signature(f).ravel() for f in images], pa.list_(pa.float32()))
            luma = pa.array([float(gray(f).mean()) for f in images], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("video"), batch.column("seq"), batch.column("timestamp"), signatures, luma], names=["video", "seq", "timestamp", "signature", "luma"])

    rows = frames.filter("pixels IS NOT NULL AND height > 0 AND width > 0").selectExpr("video", "cast(seq as bigint) as seq", "cast(timestamp as double) as timestamp", "cast(height as int) as height", "cast(width as int) as width", "pixels")
    return rows.mapInArrow(run, "video string, seq bigint, timestamp double, signature array<float>, luma double")


def enhanced_frames(frames: DataFrame, variants: tuple[str, ...] = tuple(VARIANTS)[1:]) -> DataFrame:
    """(video, seq, variant, height, width, pixels) of (video, seq, height, width, pixels): a row per frame and variant, of one channel
    unless it is the original. Frames without pixels are left out; an unknown variant is an error at once."""
    if unknown := set(variants) - set(VARIANTS):
        raise ValueError(f"unknown variant {min(unknown)!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                height, width, pixels = (batch.column(c)[row].as_py() for c in ("height", "width", "pixels"))
                frame = as_frame(height, width, pixels)
                made = [prepare(frame, v).tobytes() for v in variants]
                n = len(variants)
                same = lambda c: pa.array([batch.column(c)[row].as_py()] * n, batch.schema.field(c).type)
                yield pa.RecordBatch.from_arrays([same("video"), same("seq"), pa.array(variants, pa.string()), same("height"), same("width"), pa.array(made, pa.binary())], names=["video", "seq", "variant", "height", "width", "pixels"])

    rows = frames.filter("pixels IS NOT NULL AND height > 0 AND width > 0").selectExpr("video", "cast(seq as bigint) as seq", "cast(height as int) as height", "cast(width as int) as width", "pixels")
    return rows.mapInArrow(run, "video string, seq bigint, variant string, height int, width int, pixels binary")

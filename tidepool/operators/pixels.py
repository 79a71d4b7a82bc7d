"""Image kernels: numpy over Arrow batches, one row an image.

Images are rows with h, w, c and data (row-major bytes).  Kernels take and give an array of
shape (h, w, c); ``apply`` maps one over a DataFrame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[..., np.ndarray]


#: Images whose results are held at a time; a kernel may enlarge them.
SLICE = 16


def in_slices(parts: Iterator[pd.DataFrame], size: int = SLICE) -> Iterator[pd.DataFrame]:
    for part in parts:
        for k in range(0, len(part), size):
            yield part.iloc[k : k + size]


def pixels_of(part: pd.DataFrame) -> Iterator[np.ndarray]:
    for d, h, w, c in zip(part["data"], part["h"], part["w"], part["c"], strict=True):
        yield np.frombuffer(d, np.uint8).reshape(h, w, c)


def apply(rows: DataFrame, kernel: Kernel, *params: str) -> DataFrame:
    """``rows`` with h, w, c, data replaced by the kernel's result; ``params`` name columns handed to it."""
    schema = rows.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(parts):
            out = [kernel(a, *p) for a, *p in zip(pixels_of(part), *(part[x] for x in params), strict=True)]
            part = part.assign(h=[x.shape[0] for x in out], w=[x.shape[1] for x in out], c=[x.shape[2] for x in out], data=[x.astype(np.uint8).tobytes() for x in out])
            yield part[schema.names]

    return rows.mapInPandas(run, schema)


def from_spark_images(images: DataFrame) -> DataFrame:
    """Rows of the image source, which has BGR: RGB of three channels; gray is repeated, alpha goes. Other columns stay."""
    flat = images.select(*[c for c in images.columns if c != "image"], F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    return apply(flat, three_channels)


def three_channels(a: np.ndarray) -> np.ndarray:
    return np.repeat(a, 3, 2) if a.shape[2] == 1 else a[:, :, 2::-1]


def _weights(n: int, m: int, filter_: Callable, reach: float) -> np.ndarray:
    """(m, n) weights of a separable resampler, widened when it shrinks."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m
    at = (np.arange(n) + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(at) < reach, filter_(at), 0.0)
    return w / w.sum(1, keepdims=True)


def _resample(a: np.ndarray, w: int, h: int, filter_: Callable, reach: float) -> np.ndarray:
    out = np.tensordot(_weights(a.shape[0], h, filter_, reach), a.astype(float), (1, 0))
    out = np.tensordot(_weights(a.shape[1], w, filter_, reach), out, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def lanczos(a: np.ndarray, w: int, h: int) -> np.ndarray:
    return _resample(a, w, h, lambda x: np.sinc(x) * np.sinc(x / 3), 3)


def bicubic(a: np.ndarray, w: int, h: int) -> np.ndarray:
    def cubic(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2)

    return _resample(a, w, h, cubic, 2)


def area(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Mean over the area that each new pixel covers."""

    def cover(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        part = np.clip(np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n)), 0, None)
        return part / part.sum(1, keepdims=True)

    out = np.tensordot(cover(a.shape[0], h), a.astype(float), (1, 0))
    return np.clip(np.rint(np.tensordot(cover(a.shape[1], w), out, (1, 1)).transpose(1, 0, 2)), 0, 255).astype(np.uint8)


def sampled(a: np.ndarray, x: np.ndarray, y: np.ndarray, nearest: bool = False) -> np.ndarray:
    """Values at places between pixels, bilinear; black outside."""
    h, w = a.shape[:2]
    if nearest:
        xi, yi = np.floor(x + 0.5).astype(int), np.floor(y + 0.5).astype(int)
        ok = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
        return np.where(ok[..., None], a[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)], 0)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, a.shape[2]))
    for dx in (0, 1):
        for dy in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            weight = (1 - np.abs(x - xi)) * (1 - np.abs(y - yi))
            ok = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            out += np.where(ok, weight, 0)[..., None] * a[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def bilinear(a: np.ndarray, w: int, h: int) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    return sampled(a, np.clip((x + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1), np.clip((y + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1))


def warp(a: np.ndarray, matrix: list[float], w: int, h: int) -> np.ndarray:
    """``matrix``: nine entries from source to result; each result pixel is looked up backwards."""
    m = np.linalg.inv(np.array(matrix, float).reshape(3, 3))
    y, x = np.mgrid[0:h, 0:w]
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    d = np.where(d == 0, np.inf, d)
    return sampled(a, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d)


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise on a canvas that holds all of it."""
    h, w = a.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    cx, cy = w // 2, h // 2
    new_w, new_h = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    m = [c, s, (1 - c) * cx - s * cy + new_w / 2 - cx, -s, c, s * cx + (1 - c) * cy + new_h / 2 - cy, 0, 0, 1]
    return warp(a, m, new_w, new_h)


def rotate_in_place(a: np.ndarray, degrees: float) -> np.ndarray:
    h, w = a.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    return sampled(a, c * dx - s * dy + (w - 1) / 2, s * dx + c * dy + (h - 1) / 2, nearest=True)


def gamma(a: np.ndarray, g: float) -> np.ndarray:
    return (255.0 * (np.arange(256) / 255.0) ** (1.0 / g)).astype(np.uint8)[a]


def brightness(a: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(a * factor, 0, 255).astype(np.uint8)


def degrade(a: np.ndarray, scale: float = 0.5) -> np.ndarray:
    return bilinear(a, max(1, int(a.shape[1] * scale)), max(1, int(a.shape[0] * scale)))


def discs(a: np.ndarray, points: list, radius: int = 5, colour: tuple[int, int, int] = (0, 255, 0)) -> np.ndarray:
    """Filled discs over the image."""
    out = a.copy()
    y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
    for px, py in points:
        out[(x - px) ** 2 + (y - py) ** 2 <= radius * radius] = colour
    return out


def png(a: np.ndarray) -> bytes:
    """8-bit gray or RGB; channel order is taken as it is."""
    h, w, c = a.shape
    raw = b"".join(b"\0" + a[k].tobytes() for k in range(h))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def encoded(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``content``, the image as PNG."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(parts):
            yield part.assign(content=[png(a) for a in pixels_of(part)])

    return rows.mapInPandas(run, rows.withColumn("content", F.lit(None).cast("binary")).schema)


def tensors(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``tensor``: channels first, each value over 255, in single precision, flat."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(parts):
            yield part.assign(tensor=[(a.transpose(2, 0, 1) / np.float32(255)).ravel() for a in pixels_of(part)])

    return rows.mapInPandas(run, rows.withColumn("tensor", F.lit(None).cast("array<float>")).schema)

"""Image tensors: decoding through Spark's image source, resizing, seeded augmentation and normalisation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Channel means and deviations that normalise photographs.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels, data (rows of BGR bytes); files that are no image are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    return raw.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def normalised(values: Column, channel: int | Column) -> Column:
    """(x / 255 - mean) / deviation of every value of one channel."""
    pick = lambda t: F.element_at(F.array(*map(F.lit, t)), (channel if isinstance(channel, Column) else F.lit(channel)) + 1)
    return F.transform(values, lambda x: (x / 255.0 - pick(MEAN)) / pick(STD))


def _resize(a: np.ndarray, size: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    h, w = a.shape[:2]
    at = lambda n: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    y, x = at(h), at(w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None, None], (x - x0)[None, :, None]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


Step = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def flipped(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return a[:, ::-1] if rng.random() < 0.5 else a


def rotated(a: np.ndarray, rng: np.random.Generator, degrees: float = 10.0) -> np.ndarray:
    """Turned about the centre by up to ``degrees``, nearest pixel; corners that come in are black."""
    t = np.deg2rad(rng.uniform(-degrees, degrees))
    h, w = a.shape[:2]
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    from_y = np.rint(np.cos(t) * y + np.sin(t) * x + (h - 1) / 2).astype(int)
    from_x = np.rint(np.cos(t) * x - np.sin(t) * y + (w - 1) / 2).astype(int)
    inside = (from_y >= 0) & (from_y < h) & (from_x >= 0) & (from_x < w)
    return np.where(inside[:, :, None], a[np.clip(from_y, 0, h - 1), np.clip(from_x, 0, w - 1)], 0.0)


def jittered(a: np.ndarray, rng: np.random.Generator, most: float = 0.2) -> np.ndarray:
    """Brightness, then contrast around the mean, each changed by up to ``most``."""
    a = np.clip(a * rng.uniform(1 - most, 1 + most), 0, 1)
    return np.clip((a - a.mean()) * rng.uniform(1 - most, 1 + most) + a.mean(), 0, 1)


TRAINING: tuple[Step, ...] = (flipped, rotated, jittered)


def tensors(images: DataFrame, size: int = 224, steps: tuple[Step, ...] = (), seed: int = 42) -> DataFrame:
    """path, x: normalised RGB values in channel, row, column order.

    ``steps`` is a chain of functions of an image (rows, columns, RGB in 0..1) and a random generator that depends on (seed,
    path) alone; ``TRAINING`` is the usual one, evaluation has none.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for path, h, w, c, data in pdf[["path", "height", "width", "channels", "data"]].itertuples(index=False):
                a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c).astype(float)
                a = np.repeat(a, 3, axis=2) if c == 1 else a[:, :, 2::-1]
                a = _resize(a, size) / 255.0
                rng = np.random.default_rng([seed, *path.encode()])
                for step in steps:
                    a = step(a, rng)
                out.append((((a - MEAN) / STD).transpose(2, 0, 1)).ravel().astype(np.float32))
            yield pd.DataFrame({"path": pdf["path"], "x": out})

    return images.mapInPandas(run, "path string, x array<float>")

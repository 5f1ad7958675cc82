"""Image augmentation and sampling on flat pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.hashing import key_md5, uniform


def sample_images(df: DataFrame, key: str, n: int = 9, seed: int = 157) -> DataFrame:
    """``n`` rows in keyed random order."""
    return df.orderBy(key_md5(key, seed), key).limit(n)


def _draw(key: str, seed: int, what: str, reach: float) -> Column:
    return (uniform(key, f"{seed}{what}") * 2 - 1) * F.lit(reach)


def _warp(images: np.ndarray, side: int, angle, zoom, dx, dy) -> np.ndarray:
    """Rotate, zoom and shift a batch about the centre; bilinear, edges repeated."""
    mid = (side - 1) / 2
    grid_y, grid_x = np.mgrid[0:side, 0:side]
    y, x = (grid_y - mid)[None], (grid_x - mid)[None]
    cos, sin = (f(np.deg2rad(angle))[:, None, None] for f in (np.cos, np.sin))
    scale = (1 + zoom)[:, None, None]
    from_y = (cos * y - sin * x) * scale + mid + (dy * side)[:, None, None]
    from_x = (sin * y + cos * x) * scale + mid + (dx * side)[:, None, None]
    from_y, from_x = np.clip(from_y, 0, side - 1), np.clip(from_x, 0, side - 1)
    y0, x0 = np.floor(from_y).astype(int), np.floor(from_x).astype(int)
    y1, x1 = np.minimum(y0 + 1, side - 1), np.minimum(x0 + 1, side - 1)
    wy, wx = from_y - y0, from_x - x0
    im = images.reshape(-1, side, side)
    n = np.arange(len(im))[:, None, None]
    top = im[n, y0, x0] * (1 - wx) + im[n, y0, x1] * wx
    bottom = im[n, y1, x0] * (1 - wx) + im[n, y1, x1] * wx
    return (top * (1 - wy) + bottom * wy).reshape(len(im), -1)


def augment(
    df: DataFrame, key: str, pixels: str, side: int, rotation: float = 10.0, zoom: float = 0.1, shift: float = 0.1, seed: int = 157
) -> DataFrame:
    """Random rotation (degrees), zoom and shift (shares) of square images: ``(key, pixels)``.

    The amounts are drawn from the row key, so a retried task produces the same image.
    """
    amounts = {"__angle": rotation, "__zoom": zoom, "__dx": shift, "__dy": shift}
    rows = df.select(key, F.col(pixels).cast("array<double>").alias(pixels), *[_draw(key, seed, a, r).alias(a) for a, r in amounts.items()])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                images = np.stack(b[pixels].to_numpy()).astype(float)
                warped = _warp(images, side, *[b[a].to_numpy() for a in amounts])
                yield pd.DataFrame({key: b[key].to_numpy(), pixels: list(warped)})

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(apply, f"`{key}` {kind}, `{pixels}` array<double>")

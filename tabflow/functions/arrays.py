"""Array-column expressions for vectors and flat images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(a: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def mean_square_gap(a: Column, b: Column) -> Column:
    """Mean of the squared element-wise difference of two arrays."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(a).cast("double")


def to_rows(a: Column, width: int) -> Column:
    """Cut a flat array into rows of ``width`` entries."""
    last = (F.size(a) / F.lit(width)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * width + 1, F.lit(width)))


def add_channel(image: Column) -> Column:
    """Give every pixel of a row/column image an axis of length one."""
    return F.transform(image, lambda row: F.transform(row, lambda v: F.array(v)))


def scale_pixels(a: Column, top: float = 255.0) -> Column:
    """Divide by the largest pixel value, as float."""
    return F.transform(a, lambda v: (v / F.lit(top)).cast("float"))

"""Codes, indicator columns and bins; all fitted on one table and usable on another."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators.quantiles import exact_quantiles
from tabflow.operators.rows import row_index
from tabflow.session import attach

MAX_COLUMNS = 10_000
_ONE_TASK = 1_000_000


def label_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Sorted distinct values numbered from zero, ``(col, code)``."""
    values = df.select(col).na.drop().distinct()
    if values.count() <= _ONE_TASK:
        rank = F.row_number().over(Window.partitionBy().orderBy(col)).cast("long") - 1
        return values.withColumn(name, rank)
    return row_index(values, [col], name)


def label_encode(df: DataFrame, col: str, name: str | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Add the code of each value; a value unknown to ``codes`` and NULL give NULL."""
    name = name or f"{col}_code"
    codes = label_codes(df, col) if codes is None else codes
    return attach(df, codes.withColumnRenamed("code", name), [col])


def categories(df: DataFrame, col: str, most: int = MAX_COLUMNS) -> list:
    """Sorted distinct values, refused beyond ``most``."""
    found = df.select(col).na.drop().distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values; too many for one column each")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, cols: Sequence[str], values: dict[str, list] | None = None) -> DataFrame:
    """Replace each column with 0/1 columns ``col_value`` in sorted order; NULL sets none."""
    out = df
    for c in cols:
        known = values[c] if values else categories(df, c)
        out = out.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in known})
    return out.drop(*cols)


def bin_by_edges(c: Column, inner: Sequence[float]) -> Column:
    """Right-closed bins 0..len(inner); NULL falls in bin 0."""
    out = F.lit(len(inner))
    for i in range(len(inner) - 1, -1, -1):
        out = F.when(c <= F.lit(float(inner[i])), F.lit(i)).otherwise(out)
    return F.when(c.isNull(), F.lit(0)).otherwise(out)


def equal_width_edges(df: DataFrame, col: str, bins: int = 5) -> list[float]:
    """Inner borders of equal-width bins, rounded down to whole numbers."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    return [float(math.floor(low + i * (high - low) / bins)) for i in range(1, bins)]


def quantile_edges(df: DataFrame, col: str, bins: int = 4, approx: bool = False) -> list[float]:
    """Inner quantile borders, linearly interpolated; ``approx=True`` takes them from a sketch."""
    probs = [i / bins for i in range(1, bins)]
    if approx:
        return list(df.agg(F.percentile_approx(col, probs, 10_000)).first()[0])
    return exact_quantiles(df, [col], probs)[col]

"""Positions without a global sort: row numbers, prefix sums, slices, folds and splits.

Rows are first cut into contiguous ranges of the leading order columns. The range borders are
literals, so recomputing a lost task assigns every row to the same range. Per-range totals (at
most ``MAX_RANGES`` rows per series) give each range its offset, and only rows of one range are
sorted together. A series that holds a third of the table is therefore spread over many tasks.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.hashing import HASH_RANGE, key_bits
from tabflow.operators.quantiles import find_rank
from tabflow.session import attach

RANGE_ROWS = 250_000
MAX_RANGES = 16_384
_RANGE = "__range"
_POS = "__pos"


def _as_number(df: DataFrame, name: str) -> Column | None:
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return None


def with_ranges(df: DataFrame, order_by: str | Sequence[str], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """Add the range number of the rows in an order; also return how many ranges there are.

    The number never decreases along the order, so ranges can be laid end to end. Ranges are cut by the first column; a value
    of it that alone fills several ranges is cut by the second column, if that is a number or a time.
    """
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    number = _as_number(df, names[0])
    if number is None:
        return _text_ranges(df, names[0], range_rows)
    few = 256
    n, borders, nulls = df.agg(F.count(F.lit(1)), _borders(number, few), F.count(F.when(number.isNull(), 1))).first()
    wanted = _range_count(n, range_rows, MAX_RANGES)
    if wanted == 1:
        return df.withColumn(_RANGE, F.lit(0)), 1
    borders = borders or []
    if wanted > few and borders:
        borders = df.agg(_borders(number, wanted)).first()[0]
    elif borders:
        step = len(borders) / wanted
        borders = [borders[int(i * step)] for i in range(1, wanted)]
    borders = [b for b in borders if math.isfinite(b)]
    splits = [-math.inf, *sorted(set(borders)), math.inf]
    # NULL sorts first and NaN last, in the ranges as in the order itself.
    placed = df.withColumn("__number", F.when(F.isnan(number), F.lit(math.inf)).otherwise(F.coalesce(number, F.lit(-math.inf))))
    if len(splits) < 3:
        out = placed.withColumn("__cut", F.lit(0.0))
    else:
        out = Bucketizer(splits=splits, inputCol="__number", outputCol="__cut").transform(placed)
    tied = {v: m for v, m in Counter(borders).items() if m > 1}
    if nulls * wanted > 2 * n:
        tied[-math.inf] = nulls * wanted // n
    second = _as_number(df, names[1]) if len(names) > 1 else None
    if not tied or second is None:
        return out.withColumn(_RANGE, F.col("__cut").cast("int")).drop("__number", "__cut"), len(splits) - 1
    return _tied_ranges(out, second, splits, tied)


def _tied_ranges(out: DataFrame, second: Column, splits: list[float], tied: dict[float, int]) -> tuple[DataFrame, int]:
    """Cut the ranges that begin with a value that fills several by the second column."""
    spark, parts = out.sparkSession, max(tied.values()) + 1
    after = F.when(F.isnan(second), F.lit(math.inf)).otherwise(F.coalesce(second, F.lit(-math.inf)))
    heavy = spark.createDataFrame([(v,) for v in tied], "__number double")
    # One row per value that fills several ranges, of which there are at most MAX_RANGES / 2.
    found = out.join(F.broadcast(heavy), "__number", "left_semi").groupBy("__number").agg(_borders(after, parts).alias("b")).collect()
    inner = {}
    for v, b in found:
        m = tied[v]
        inner[v] = sorted({b[min(len(b) - 1, round(k * len(b) / (m + 1)))] for k in range(1, m + 1)})
    table, offset = [], 0
    # A constant column has one range, which begins with its value.
    starts = splits[:-1] if len(splits) > 2 or -math.inf in tied else [next(iter(tied))]
    for k, low in enumerate(starts):
        table.append((float(k), offset, low if low in inner else None, inner.get(low, [])))
        offset += 1 + (len(inner[low]) + 1 if low in inner else 0)
    # At most MAX_RANGES rows.
    known = F.broadcast(spark.createDataFrame(table, "__cut double, __off int, __tie double, __inner array<double>"))
    own = F.when(F.col("__number") == F.col("__tie"), F.size(F.filter("__inner", lambda b: b <= after))).when(F.col("__number") < F.col("__tie"), F.lit(0))
    place = F.when(F.col("__tie").isNull(), F.lit(0)).otherwise(F.coalesce(own, F.size("__inner") + 1))
    out = out.join(known, "__cut").withColumn(_RANGE, (F.col("__off") + place).cast("int"))
    return out.drop("__number", "__cut", "__off", "__tie", "__inner"), offset


def _range_count(n: int, range_rows: int, most: int) -> int:
    """One range up to ``range_rows`` rows. Beyond, smaller ones, which spread more evenly over tasks."""
    return 1 if n <= range_rows else min(most, math.ceil(2.5 * n / range_rows))


def _borders(number: Column, parts: int) -> Column:
    return F.percentile_approx(number, [i / parts for i in range(1, parts)], max(10_000, parts * 8))


def _text_ranges(df: DataFrame, name: str, range_rows: int) -> tuple[DataFrame, int]:
    """Ranges of a text column. The sample only places the borders; no row is left out."""
    n = df.count()
    wanted = _range_count(n, range_rows, MAX_RANGES // 4)
    if wanted == 1:
        return df.withColumn(_RANGE, F.lit(0)), 1
    share = min(1.0, 40 * wanted / n)
    seen = sorted(r[0] for r in df.select(name).na.drop().sample(share, seed=157).collect())
    borders = sorted({seen[len(seen) * i // wanted] for i in range(1, wanted)}) if seen else []

    @F.pandas_udf("int")
    def place(s: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(s)
        spots = np.array([bisect.bisect_right(borders, v) for v in distinct], "int32")
        # NULL has the code -1 and belongs to the first range.
        return pd.Series(np.where(codes < 0, 0, spots[codes] if len(spots) else 0).astype("int32"))

    return df.withColumn(_RANGE, place(F.col(name))), len(borders) + 1


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _add_offsets(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add what lies before each range. The rows are already laid out by the join keys."""
    if not keys:
        # One row per range, at most MAX_RANGES.
        offsets = F.broadcast(offsets)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    sums = {v: F.when(known, F.col(v) + F.coalesce(f"{v}__before", F.lit(0))) for v in values}
    return rows.join(offsets, [*keys, _RANGE], "left").withColumns(sums).select(*[c for c in rows.columns if c != _RANGE])


def row_index(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "idx",
    partition_by: Sequence[str] = (),
    start: int = 0,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Number the rows in order, optionally inside each series, from ``start``.

    A row whose series key is NULL belongs to no series and gets NULL.
    """
    cut, ranges = with_ranges(df, order_by, range_rows)
    within = Window.partitionBy(*partition_by, *([_RANGE] if ranges > 1 else [])).orderBy(*order_by)
    numbered = cut.withColumn(name, F.row_number().over(within).cast("long") + F.lit(start - 1))
    if ranges == 1:
        for k in partition_by:
            numbered = numbered.withColumn(name, F.when(F.col(k).isNotNull(), F.col(name)))
        return numbered.drop(_RANGE)
    totals = cut.groupBy(*partition_by, _RANGE).agg(F.count(F.lit(1)).alias("__n"))
    offsets = totals.withColumn(f"{name}__before", F.sum("__n").over(_earlier(partition_by))).drop("__n")
    return _add_offsets(numbered, offsets, partition_by, [name])


def prefix_sums(
    df: DataFrame,
    order_by: Sequence[str],
    sums: dict[str, Column],
    partition_by: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Running sums in order, the current row included."""
    cut, ranges = with_ranges(df.withColumns(sums), order_by, range_rows)
    parts = [*partition_by, *([_RANGE] if ranges > 1 else [])]
    within = Window.partitionBy(*parts).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    running = cut.withColumns({s: F.sum(s).over(within) for s in sums})
    if ranges == 1:
        return running.drop(_RANGE)
    totals = cut.groupBy(*partition_by, _RANGE).agg(*[F.sum(s).alias(s) for s in sums])
    before = {f"{s}__before": F.sum(s).over(_earlier(partition_by)) for s in sums}
    offsets = totals.withColumns(before).drop(*sums)
    return _add_offsets(running, offsets, partition_by, list(sums))


def min_rank(df: DataFrame, by: str, name: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rank by falling value where ties share the smallest rank."""
    sizes = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__down", -F.col(by))
    running = prefix_sums(sizes, ["__down"], {"__upto": F.col("__n")}, range_rows=range_rows)
    ranks = running.select(by, (F.col("__upto") - F.col("__n") + 1).alias(name))
    return df.join(ranks, by, "left")


def _unique_at(df: DataFrame, order_by: Sequence[str], position: int):
    """Key of the row at a position, where one numeric key orders the rows and is unique there.

    A cut at that row is then a comparison that reaches the scan, without any sort.
    """
    if len(order_by) > 1 or not isinstance(df.schema[order_by[0]].dataType, T.NumericType):
        return None
    if df.filter(F.col(order_by[0]).isNull()).limit(1).count():
        return None
    border, _, equal = find_rank(df, order_by[0], position)
    return border if equal == 1 else None


def head_tail(df: DataFrame, order_by: Sequence[str], last: int, **kw) -> tuple[DataFrame, DataFrame]:
    """Split off the last rows: everything before them, and the rows themselves."""
    n = df.count()
    border = _unique_at(df, order_by, n - last) if 0 < last <= n else None
    if border is not None:
        return df.filter(F.col(order_by[0]) < F.lit(border)), df.filter(F.col(order_by[0]) >= F.lit(border))
    placed = row_index(df, order_by, _POS, **kw)
    is_tail = F.col(_POS) >= F.lit(n - last)
    return placed.filter(~is_tail).drop(_POS), placed.filter(is_tail).drop(_POS)


def split_at(df: DataFrame, order_by: Sequence[str], position: int, **kw) -> tuple[DataFrame, DataFrame]:
    """Label-style split: the row at ``position`` belongs to both parts."""
    border = _unique_at(df, order_by, position) if 0 <= position < df.count() else None
    if border is not None:
        return df.filter(F.col(order_by[0]) <= F.lit(border)), df.filter(F.col(order_by[0]) >= F.lit(border))
    placed = row_index(df, order_by, _POS, **kw)
    first = placed.filter(F.col(_POS) <= F.lit(position)).drop(_POS)
    return first, placed.filter(F.col(_POS) >= F.lit(position)).drop(_POS)


def tumbling(
    df: DataFrame, order_by: Sequence[str], size: int, partition_by: Sequence[str] = (), name: str = "window_id", **kw
) -> DataFrame:
    """Blocks of ``size`` consecutive rows, numbered from 1; rows of an unfinished block are left out."""
    placed = row_index(df, order_by, _POS, partition_by, **kw)
    if partition_by:
        lengths = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("__n"))
        placed = attach(placed, lengths, list(partition_by))
        full = F.floor(F.col("__n") / F.lit(size)) * size
    else:
        full = F.lit(df.count() // size * size)
    block = (F.floor(F.col(_POS) / F.lit(size)) + 1).cast("long")
    return placed.filter(F.col(_POS) < full).withColumn(name, block).drop(_POS, "__n")


def contiguous_folds(df: DataFrame, order_by: Sequence[str], k: int, name: str = "fold", **kw) -> DataFrame:
    """Unshuffled folds; the first ``n % k`` folds hold one row more."""
    n = df.count()
    placed = row_index(df, order_by, _POS, **kw)
    small, extra = divmod(n, k)
    border = extra * (small + 1)
    pos = F.col(_POS)
    in_large = F.floor(pos / F.lit(small + 1))
    in_small = F.lit(extra) + F.floor((pos - F.lit(border)) / F.lit(max(small, 1)))
    return placed.withColumn(name, F.when(pos < F.lit(border), in_large).otherwise(in_small).cast("int")).drop(_POS)


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int, seed: int = 157, name: str = "fold", **kw
) -> DataFrame:
    """Folds that keep class shares: rows of a class are dealt out in a keyed random order."""
    mixed = df.withColumn("__h", key_bits(key, seed))
    placed = row_index(mixed, ["__h", key], _POS, [label], **kw)
    return placed.withColumn(name, (F.col(_POS) % k).cast("int")).drop("__h", _POS)


def split_random(df: DataFrame, key: str, share: float, seed: int = 157, name: str = "is_test") -> DataFrame:
    """Mark exactly ``ceil(share * n)`` rows as test rows.

    The size is exact and no row moves: the border is the m-th smallest key hash, found by
    aggregates, and the split is a comparison with it.
    """
    mixed = df.withColumn("__h", key_bits(key, seed))
    n = df.count()
    m = math.ceil(round(share * n, 9))
    if m == 0:
        return df.withColumn(name, F.lit(0))
    # The hash is uniform, so its m-th smallest value lies near share * range.
    p = m / n
    reach = 8 * math.sqrt(p * (1 - p) / n) + 2 / n
    bracket = (int((p - reach) * HASH_RANGE), int((p + reach) * HASH_RANGE))
    border, below, equal = find_rank(mixed, "__h", m - 1, bracket=bracket)
    is_test = F.col("__h") <= F.lit(border)
    if below + equal > m:
        last = mixed.filter(F.col("__h") == F.lit(border)).orderBy(key).limit(m - below).collect()[-1][key]
        is_test = (F.col("__h") < F.lit(border)) | ((F.col("__h") == F.lit(border)) & (F.col(key) <= F.lit(last)))
    return mixed.withColumn(name, is_test.cast("int")).drop("__h")


def split_stratified(
    df: DataFrame, key: str, label: str, share: float, seed: int = 157, name: str = "is_test", **kw
) -> DataFrame:
    """Mark ``ceil(share * n_class)`` rows of every class as test rows."""
    mixed = df.withColumn("__h", key_bits(key, seed))
    placed = row_index(mixed, ["__h", key], _POS, [label], **kw)
    sizes = df.groupBy(label).agg(F.ceil(F.round(F.count(F.lit(1)) * F.lit(share), 9)).alias("__m"))
    is_test = F.coalesce((F.col(_POS) < F.col("__m")).cast("int"), F.lit(0))
    marked = attach(placed, sizes, [label]).withColumn(name, is_test)
    return marked.select(*df.columns, name)

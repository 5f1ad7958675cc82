"""Table statistics in one pass each: profiles, covariance, correlation, histograms, mutual information."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators.rows import RANGE_ROWS, prefix_sums
from tabflow.session import attach, cut_lineage

_PAIRS_IN_ONE_AGG = 300


def profile(df: DataFrame) -> DataFrame:
    """Rows, filled cells and type per column, ``(column, dtype, n_rows, n_filled)``."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in df.columns])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("__n").alias("n_rows"), F.col(c).alias("n_filled"))
        for c, t in df.dtypes
    ]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def unpivot(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per cell: ``(keep..., column, value)`` with the value as double."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.*")


def distinct_count(df: DataFrame, col: str, approx: bool = False, name: str = "n") -> DataFrame:
    """Number of distinct values; ``approx=True`` takes it from a sketch, without shuffling the values."""
    return df.agg((F.approx_count_distinct(col, 0.01) if approx else F.count_distinct(col)).alias(name))


def column_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, min, max)``."""
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c)["min"].alias("min"), F.col(c)["max"].alias("max")) for c in cols]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def mean_cov(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance and both means of every column pair, ``(col_i, col_j, mean_i, mean_j, cov)``.

    A mean is over the rows where the column is filled, a covariance over those where both are, NULL below two of
    them; a NaN among these rows gives NaN. Few columns are aggregated side by side. With many, the expression list would
    outgrow generated code, so tasks add up matrices and only sums are shuffled; NULL and NaN count alike in both.
    """
    pairs = list(combinations_with_replacement(cols, 2))
    if len(pairs) <= _PAIRS_IN_ONE_AGG:
        one = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.covar_samp(a, b).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)],
        )
        cells = [
            F.struct(
                F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.col(f"m_{a}").alias("mean_i"),
                F.col(f"m_{b}").alias("mean_j"), F.col(f"c_{i}").alias("cov"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
        return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    mean, cov = pair_moments(df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v")), "v")
    rows = [(cols[i], cols[j], mean[i], mean[j], cov[i][j]) for i, j in combinations_with_replacement(range(len(cols)), 2)]
    return df.sparkSession.createDataFrame(rows, "col_i string, col_j string, mean_i double, mean_j double, cov double")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of an array column with 0 for NULL and NaN, and where a value is filled, and where it is NaN."""
    vectors = batch.column(0).drop_null()
    flat = vectors.flatten()
    filled = flat.is_valid().to_numpy(zero_copy_only=False)
    x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    nan = np.isnan(x)
    shape = (len(vectors), -1) if len(vectors) else (0, 0)
    return np.where(nan, 0.0, x).reshape(shape), filled.reshape(shape), nan.reshape(shape)


def _matrix_sums(rows: DataFrame, make, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Sum of the square matrices that ``make`` gives for each batch, by name.

    Every task adds up its batches. The matrices are summed line by line: a group holds one line per task, whatever the
    number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows > batch.column(0).null_count:
                found = make(batch)
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        for k, m in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["k", "i", "line"])

    def add_lines(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "i": pdf["i"].iloc[:1], "line": [np.stack(pdf["line"].to_numpy()).sum(axis=0)]})

    shape = "k int, i int, line array<double>"
    lines = sorted(rows.mapInArrow(run, shape).groupBy("k", "i").applyInPandas(add_lines, shape).collect(), key=lambda r: (r["k"], r["i"]))
    return {name: np.array([r["line"] for r in lines if r["k"] == k]) for k, name in enumerate(names)}


def pair_moments(df: DataFrame, vector: str) -> tuple[list, list]:
    """Mean of every entry of an array column, and sample covariance of every pair, over the rows where both are filled.

    None where there are too few rows; NaN where one of the rows has it.
    """
    rows = df.select(vector)

    def first(batch: pa.RecordBatch) -> list[np.ndarray]:
        x, filled, nan = _entries(batch)
        return [np.stack([x.sum(axis=0), filled.sum(axis=0), nan.sum(axis=0)]).astype(float)]

    sums = _matrix_sums(rows, first, ["s"])["s"]
    if not len(sums):
        return [], []
    centre = sums[0] / np.maximum(sums[1] - sums[2], 1)

    def second(batch: pa.RecordBatch) -> list[np.ndarray]:
        x, filled, nan = _entries(batch)
        m, bad = filled.astype(float), nan.astype(float)
        x = np.where(filled & ~nan, x - centre, 0.0)
        # Pairs of filled entries, sums of one where the other is filled, products, and pairs with a NaN.
        return [m.T @ m, x.T @ m, x.T @ x, bad.T @ m + m.T @ bad]

    found = _matrix_sums(rows, second, ["n", "s", "p", "nan"])
    n, s, p, nan = (found[k] for k in ("n", "s", "p", "nan"))
    with np.errstate(all="ignore"):
        cov = (p - s * s.T / n) / (n - 1)
    size = range(len(centre))
    mean = [None if not sums[1][i] else float("nan") if sums[2][i] else float(sums[0][i] / sums[1][i]) for i in size]
    return mean, [[None if n[i, j] < 2 else float("nan") if nan[i, j] else float(cov[i, j]) for j in size] for i in size]


def gram_moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and centred sum of products of an array column, over the rows without NULL or NaN in it."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v))
    rows = df.select(F.col(vector).cast("array<double>").alias(vector)).filter(whole)

    def first(batch: pa.RecordBatch) -> list[np.ndarray]:
        x = _entries(batch)[0]
        return [np.stack([x.sum(axis=0), np.full(x.shape[1], float(len(x)))])]

    sums = _matrix_sums(rows, first, ["s"])["s"]
    if not len(sums):
        raise ValueError("no row is filled")
    n = int(sums[1][0])
    mean = sums[0] / n

    def second(batch: pa.RecordBatch) -> list[np.ndarray]:
        x = _entries(batch)[0] - mean
        return [x.T @ x]

    return n, mean, _matrix_sums(rows, second, ["p"])["p"]


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, NULL where a column is constant."""
    cov = mean_cov(df, cols)
    own = cov.filter(F.col("col_i") == F.col("col_j")).select(F.col("col_i").alias("c"), F.sqrt("cov").alias("sd"))
    left = own.select(F.col("c").alias("col_i"), F.col("sd").alias("sd_i"))
    right = own.select(F.col("c").alias("col_j"), F.col("sd").alias("sd_j"))
    # One row per column and per column pair on all sides.
    joined = cov.join(F.broadcast(left), "col_i").join(F.broadcast(right), "col_j")
    return joined.select("col_i", "col_j", F.try_divide(F.col("cov"), F.col("sd_i") * F.col("sd_j")).alias("corr"))


def bin_number(c: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of a value; the top edge belongs to the last bin. Without limits there is no value and no bin."""
    if low is None:
        return F.lit(None).cast("int")
    width = high - low
    if not width:
        return F.when(c.isNotNull(), F.lit(0))
    return F.least(F.floor((c - F.lit(low)) / F.lit(width) * F.lit(bins)), F.lit(bins - 1)).cast("int")


def _limits(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    s = df.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(c) for c in cols]).first()
    return {c: (s[c][0], s[c][1]) for c in cols}


def histogram_by_class(df: DataFrame, cols: Sequence[str], label: str, bins: int = 100) -> DataFrame:
    """Counts per feature, class and bin; a column of zeros only is left out, and so is one of NULL only."""
    limits = {c: v for c, v in _limits(df, cols).items() if v != (0.0, 0.0) and v[0] is not None}
    cells = [
        F.struct(F.lit(c).alias("column"), bin_number(F.col(c).cast("double"), *v, bins).alias("bin")) for c, v in limits.items()
    ]
    cells = cells or [F.lit(None).cast("struct<column:string,bin:int>")]
    long = df.select(label, F.explode(F.array(*cells)).alias("c")).filter("c is not null").select(label, "c.*")
    return long.groupBy("column", label, "bin").agg(F.count(F.lit(1)).alias("n"))


def mutual_info(
    df: DataFrame, cols: Sequence[str], label: str, bins: int = 10, label_bins: int | None = None
) -> DataFrame:
    """Mutual information of each column with the label, on equal-width bins: ``(column, mi)``.

    ``label_bins`` cuts a real-valued label as well. This is the plug-in estimate on bins; the
    nearest-neighbour estimator gives other values.
    """
    limits = _limits(df, [*cols, *([label] if label_bins else [])])
    y = bin_number(F.col(label).cast("double"), *limits[label], label_bins) if label_bins else F.col(label)
    cells = [
        F.struct(F.lit(c).alias("column"), bin_number(F.col(c).cast("double"), *limits[c], bins).alias("x")) for c in cols
    ]
    long = df.select(y.alias("y"), F.explode(F.array(*cells)).alias("c")).select("y", "c.*").na.drop()
    # At most columns x bins x classes rows from here on.
    joint = long.groupBy("column", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column"))
    nx = F.sum("n").over(Window.partitionBy("column", "x"))
    ny = F.sum("n").over(Window.partitionBy("column", "y"))
    parts = joint.select("column", "n", total.alias("t"), nx.alias("nx"), ny.alias("ny"))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return parts.groupBy("column").agg(F.sum(term).alias("mi"))


def digamma(n: Column) -> Column:
    """Digamma function of a whole number above 0, to ten digits: a table up to 20, its series beyond."""
    gamma = 0.5772156649015329
    small = F.array(*[F.lit(sum(1 / i for i in range(1, k)) - gamma) for k in range(1, 21)])
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0)))
    return F.when(n <= 20, F.get(small, (n - 1).cast("int"))).otherwise(series)


def mutual_info_neighbors(df: DataFrame, cols: Sequence[str], label: str, k: int = 3, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Mutual information of each real column with a class, by nearest neighbours (Ross 2014): ``(column, mi)``, not below 0.

    A row's radius is the distance to its k-th neighbour of the same class (to the furthest, if the class has fewer others); m counts all rows closer
    than that, itself included, or at radius 0 those of equal value. ``mi = psi(N) + mean psi(k) - mean psi(class size) - mean psi(m)``. Rows
    with a null label, a NULL or a NaN, and classes of one row, are left out; a column without rows has no result.

    Nothing is paired. Rows get their place in their class by ranges; a run of ``range_rows`` places with a halo of k on both sides holds all its
    neighbours, so a class may be as large as the table. m is the difference of two running counts over values and borders in one order.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*cells)).alias("c")).select("y", "c.*").filter("y is not null and x is not null and not isnan(x)")
    sizes = long.groupBy("column", "y").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    placed = prefix_sums(attach(cut_lineage(long), sizes, ["column", "y"], "inner"), ["x"], {"place": F.lit(1).cast("long")}, ["column", "y"], range_rows)
    placed = cut_lineage(placed.select("column", "y", "x", "size", (F.col("place") - 1).alias("place")))
    run, at = F.floor(F.col("place") / range_rows), F.col("place") % range_rows
    runs = F.array_compact(F.array(run, F.when(at < k, run - 1), F.when(at >= range_rows - k, run + 1)))
    near = placed.withColumn("home", run).withColumn("run", F.explode(runs))
    order = Window.partitionBy("column", "y", "run").orderBy("place")
    gaps = [F.abs(side(F.col("x"), i).over(order) - F.col("x")) for i in range(1, k + 1) for side in (F.lag, F.lead)]
    near = near.withColumn("gaps", F.array_sort(F.array_compact(F.array(*gaps)))).filter("run = home")
    used = F.least(F.lit(k), F.col("size") - 1)
    near = near.withColumn("k", used).withColumn("radius", F.element_at("gaps", used.cast("int")))
    # The neighbour itself is on the border and must not count, however the sum is rounded.
    inner = F.greatest(F.lit(0.0), F.col("radius") * (1 - 1e-12) - F.abs("x") * 4e-16)
    near = cut_lineage(near.select("column", "y", "place", "x", "size", "k", inner.alias("inner")))
    points = near.select("column", F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("w"), "y", "place")
    borders = [near.select("column", (F.col("x") + sign * F.col("inner")).alias("v"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("w"), "y", "place") for sign, kind in ((-1, 0), (1, 2))]
    # Values equal to the lower border are not below it, those equal to the upper one are.
    counted = prefix_sums(points.unionByName(borders[0]).unionByName(borders[1]), ["v", "kind"], {"upto": F.col("w")}, ["column"], range_rows)
    inside = counted.filter("kind <> 1").groupBy("column", "y", "place").agg(F.sum(F.when(F.col("kind") == 2, F.col("upto")).otherwise(-F.col("upto"))).alias("m"))
    terms = near.join(inside, ["column", "y", "place"]).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg(digamma(F.col("k")) - digamma(F.col("size")) - digamma(F.col("m"))).alias("rest"))
    return terms.select("column", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("rest")).alias("mi"))


def top_percent(scores: DataFrame, value: str, percent: float = 40.0) -> list[str]:
    """Columns in the top share of a ``(column, value)`` table, ties by name."""
    found = sorted(((-r[value], r["column"]) for r in scores.collect()))
    keep = max(1, round(len(found) * percent / 100))
    return [c for _, c in found[:keep]]

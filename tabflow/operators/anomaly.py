"""Anomaly scores: Gaussian density, reconstruction error, isolation forest, one-class boundary."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions.arrays import mean_square_gap
from tabflow.operators.models import RandomFourier
from tabflow.operators.quantiles import exact_quantiles, kth_smallest
from tabflow.operators.scale import Pca, fit_pca
from tabflow.operators.stats import mean_cov
from tabflow.session import cut_lineage

LOG_2PI = math.log(2 * math.pi)
_WIDE = 24


@dataclass(frozen=True)
class Gaussian:
    """Mean vector and covariance of named columns."""

    cols: list[str]
    mean: np.ndarray
    cov: np.ndarray

    def log_density(self) -> Column:
        """Log density; the density itself underflows with many columns and orders the same way."""
        inverse = np.linalg.inv(self.cov)
        base = len(self.cols) * LOG_2PI + float(np.linalg.slogdet(self.cov)[1])
        if len(self.cols) > _WIDE:
            return self._wide(inverse, base)
        d = [F.col(c) - F.lit(float(m)) for c, m in zip(self.cols, self.mean, strict=True)]
        terms = [
            F.lit(float(inverse[i, j]) * (1 if i == j else 2)) * d[i] * d[j] for i in range(len(d)) for j in range(i, len(d))
        ]
        return F.lit(-0.5) * (F.lit(base) + sum(terms[1:], terms[0]))

    def _wide(self, inverse: np.ndarray, base: float) -> Column:
        mean = self.mean

        @F.pandas_udf("double")
        def score(s: pd.Series) -> pd.Series:
            if s.empty:
                return pd.Series([], dtype=float)
            d = np.stack(s.to_numpy()).astype(float) - mean
            return pd.Series(-0.5 * (base + np.einsum("ni,ij,nj->n", d, inverse, d)))

        # NULL in, NULL out, as in the narrow form.
        filled = F.lit(True)
        for c in self.cols:
            filled = filled & F.col(c).isNotNull()
        return F.when(filled, score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.cols])))

    def diagonal_log_density(self) -> Column:
        """Log density with all covariances between columns set to zero."""
        parts = [
            F.lit(-0.5) * (F.lit(LOG_2PI + math.log(v)) + (F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m))) / F.lit(float(v)))
            for c, m, v in zip(self.cols, self.mean, np.diag(self.cov), strict=True)
        ]
        return sum(parts[1:], parts[0])


def fit_gaussian(df: DataFrame, cols: Sequence[str]) -> Gaussian:
    cols = list(cols)
    at = {c: i for i, c in enumerate(cols)}
    mean, cov = np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
    for r in mean_cov(df, cols).collect():
        i, j = at[r["col_i"]], at[r["col_j"]]
        mean[i], mean[j] = r["mean_i"], r["mean_j"]
        cov[i, j] = cov[j, i] = r["cov"]
    return Gaussian(cols, mean, cov)


def reconstruction_error(df: DataFrame, vector: str, k: int, pca: Pca | None = None, out: str = "reconstruction_error") -> DataFrame:
    """Row mean of the squared gap to a k-component reconstruction (a linear autoencoder)."""
    pca = pca or fit_pca(df, vector, k)
    rebuilt = pca.reconstruct(df, vector, "__back")
    return rebuilt.withColumn(out, mean_square_gap(F.col(vector), F.col("__back"))).drop("__back")


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, int, int, float]]:
    """Split rows at random until alone; nodes are (id, feature, threshold, left, right, depth value)."""
    nodes = []
    todo = [(0, x, 0)]
    used = 1
    while todo:
        at, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(varied):
            nodes.append((at, -1, 0.0, -1, -1, depth + _path_length(len(part))))
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(low[f], high[f]))
        go = part[:, f] < cut
        left, right = used, used + 1
        used += 2
        nodes.append((at, f, cut, left, right, 0.0))
        todo += [(left, part[go], depth + 1), (right, part[~go], depth + 1)]
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays padded to one width; ``sample`` rows were used per tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    sample: int

    def score(self, vector: str) -> Column:
        """Anomaly score in (0, 1]; higher is more isolated."""
        feature, cut, left, right, depth = self.feature, self.cut, self.left, self.right, self.depth
        scale = _path_length(self.sample) or 1.0

        @F.pandas_udf("double")
        def walk(s: pd.Series) -> pd.Series:
            if s.empty:
                return pd.Series([], dtype=float)
            x = np.stack(s.to_numpy()).astype(float)
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for t in range(len(feature)):
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[t][at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.maximum(f, 0)] < cut[t][at]
                    at = np.where(inner, np.where(go_left, left[t][at], right[t][at]), at)
                total += depth[t][at]
            return pd.Series(2.0 ** (-(total / len(feature)) / scale))

        return walk(F.col(vector))


def isolation_forest(df: DataFrame, key: str, vector: str, trees: int = 50, sample: int = 256, seed: int = 157) -> IsolationForest:
    """Grow each tree on the ``sample`` rows with the smallest keyed hash (sampling is the method).

    A row is offered only to the trees whose hash cut it passes, so about four times the sample
    size per tree is shuffled, whatever the table holds. Trees grow in parallel tasks. Rows with a null vector are not looked at.
    """
    df = df.filter(F.col(vector).isNotNull())
    n = df.count()
    if not n:
        raise ValueError("there is no row with a vector")
    span = 1 << 30
    offered = span if n <= 4 * sample else max(1, int(span * 4 * sample / n))
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(span)).alias("h")),
    )
    passed = F.filter(draw, lambda d: d["h"] < offered)
    offers = df.select(F.col(key).alias("__id"), F.col(vector).cast("array<double>").alias("x"), F.explode(passed).alias("d"))
    first = Window.partitionBy("tree").orderBy("h", "__id")
    picked = offers.select("__id", "x", "d.tree", "d.h").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample)
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(np.stack(pdf["x"].to_numpy()).astype(float), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
        out.insert(0, "tree", tree)
        return out

    schema = "tree int, node int, feature int, cut double, left int, right int, depth double"
    # At most trees x 2 x sample rows.
    nodes = picked.select("tree", "x", "r").groupBy("tree").applyInPandas(grow, schema).toPandas()
    grown = sorted(nodes["tree"].unique())
    width = int(nodes["node"].max()) + 1
    shape = (len(grown), width)
    feature, left, right = np.full(shape, -1), np.zeros(shape, dtype=int), np.zeros(shape, dtype=int)
    cut, depth = np.zeros(shape), np.zeros(shape)
    row = nodes["tree"].map({t: i for i, t in enumerate(grown)}).to_numpy()
    at = nodes["node"].to_numpy()
    for target, name in ((feature, "feature"), (left, "left"), (right, "right"), (cut, "cut"), (depth, "depth")):
        target[row, at] = nodes[name].to_numpy()
    return IsolationForest(feature, cut, left, right, depth, min(sample, n))


def flag_share(scored: DataFrame, score: str, share: float, out: str = "is_outlier") -> DataFrame:
    """Call the rows above the ``1 - share`` quantile of the score outliers; null for a NULL or NaN score.

    The scored rows are written once, so that the quantile does not score them again.
    """
    scored = cut_lineage(scored)
    border = exact_quantiles(scored, [score], [1 - share])[score][0]
    return scored.withColumn(out, F.when(~F.isnan(score), (F.col(score) > F.lit(border)).cast("int")))


@dataclass(frozen=True)
class OneClass:
    """Weights on random Fourier features and the offset below which a row is outside."""

    lift: RandomFourier
    weights: np.ndarray
    offset: float

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        """Add ``margin`` and ``is_outlier`` (1 where the margin is negative)."""
        return _margin(df, vector, self.lift, self.weights).withColumn("margin", F.col("margin") - F.lit(self.offset)).withColumn(
            "is_outlier", (F.col("margin") < 0).cast("int")
        )


def _margin(df: DataFrame, vector: str, lift: RandomFourier, weights: np.ndarray) -> DataFrame:
    lifted = lift.transform(df, vector, "__phi")

    @F.pandas_udf("double")
    def dot(s: pd.Series) -> pd.Series:
        if s.empty:
            return pd.Series([], dtype=float)
        return pd.Series(np.stack(s.to_numpy()) @ weights)

    return lifted.withColumn("margin", dot(vector_to_array("__phi"))).drop("__phi")


def one_class_boundary(df: DataFrame, vector: str, nu: float = 0.2, gamma: float | str = "auto", size: int = 128, steps: int = 15, seed: int = 157) -> OneClass:
    """One-class boundary of Schoelkopf et al. (2001) on random Fourier features of the RBF kernel.

    Sub-gradient steps: each scores the rows, moves the offset to the ``nu`` quantile of the
    margins and adds up the features of the rows below it. A step shuffles one sum per feature.
    The sigmoid kernel has no such feature map.
    """
    dims = df.select(F.size(vector)).first()[0]
    lift = RandomFourier(1.0 / dims if gamma == "auto" else float(gamma), dims, size, seed)
    rows = df.select(F.col(vector).alias("v"))
    n = rows.count()
    weights = _feature_sum(rows, lift) / n
    for step in range(1, steps + 1):
        scored = _margin(rows, "v", lift, weights)
        # A step needs the offset only roughly; the last one below is exact.
        offset = scored.agg(F.percentile_approx("margin", nu, 10_000)).first()[0]
        below = scored.filter(F.col("margin") < F.lit(offset)).select("v")
        rate = 1.0 / (step + 1)
        # Minimise |w|^2 / 2 - offset + sum(max(0, offset - w.phi)) / (nu n) in w.
        weights = (1 - rate) * weights + rate * _feature_sum(below, lift) / (nu * n)
    rank = max(0, math.ceil(nu * n) - 1)
    margins = cut_lineage(_margin(rows, "v", lift, weights).select("margin"))
    return OneClass(lift, weights, float(kth_smallest(margins, "margin", rank)))


def _feature_sum(rows: DataFrame, lift: RandomFourier) -> np.ndarray:
    """Sum of the lifted rows; each task sends one number per feature."""
    lifted = lift.transform(rows, "v", "__phi").select(vector_to_array("__phi").alias("phi"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                s = np.stack(b["phi"].to_numpy()).sum(axis=0)
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(len(total)), "s": total})

    out = np.zeros(lift.size)
    for r in lifted.mapInPandas(add, "pos int, s double").groupBy("pos").agg(F.sum("s").alias("s")).collect():
        out[r["pos"]] = r["s"]
    return out

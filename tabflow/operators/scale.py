"""Scalers (fit gives a few numbers per column, transform is plain arithmetic), PCA, rank reduction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.operators.quantiles import exact_quantiles
from tabflow.operators.stats import gram_moments, mean_cov, unpivot
from tabflow.session import attach


_SIDE_BY_SIDE = 8


@dataclass(frozen=True)
class Affine:
    """``(x - shift) / spread`` per column; a spread of zero only shifts."""

    shift: dict[str, float]
    spread: dict[str, float]

    def column(self, c: str) -> Column:
        shift, spread = self.shift[c], self.spread[c]
        if shift is None:
            return F.lit(None).cast("double")
        return (F.col(c) - F.lit(float(shift))) / F.lit(float(spread) if spread else 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.shift})


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Affine:
    """Mean and population standard deviation, NULLs left out.

    A few columns are aggregated side by side. For many, one short aggregate over cells grouped by
    column beats a long expression list, which outgrows compiled code.
    """
    if len(cols) <= _SIDE_BY_SIDE:
        found = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c), F.min(c)).alias(c) for c in cols]).first().asDict()
    else:
        v = F.col("value")
        cells = unpivot(df, [], cols).groupBy("column").agg(F.struct(F.avg(v), F.stddev_pop(v), F.min(v)).alias("s"))
        found = dict.fromkeys(cols, (None, None, None)) | {r["column"]: r["s"] for r in cells.collect()}
    # The mean of a constant column may be off in the last digit; its one value is not.
    shift = {c: found[c][0] if found[c][1] else found[c][2] for c in cols}
    return Affine(shift, {c: found[c][1] for c in cols})


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fit_standard(df, cols).transform(df)


def standardise_by(df: DataFrame, split: str, cols: Sequence[str]) -> DataFrame:
    """Each split scaled with its own mean and deviation."""
    named = [
        x for c in cols for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))
    ]
    joined = attach(df, df.groupBy(split).agg(*named), [split])
    scaled = {
        c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
        for c in cols
    }
    return joined.withColumns(scaled).select(*df.columns)


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Affine:
    """Median and distance between the quartiles."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return Affine({c: q[c][1] for c in cols}, {c: (q[c][2] or 0.0) - (q[c][0] or 0.0) for c in cols})


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> Affine:
    s = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in cols]).first()
    return Affine({c: s[c][0] for c in cols}, {c: (s[c][1] or 0.0) - (s[c][0] or 0.0) for c in cols})


def sum_normalise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each value as a share of its column total."""
    totals = df.agg(*[F.sum(c).cast("double").alias(c) for c in cols]).first()
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), F.lit(totals[c])) for c in cols})


@dataclass(frozen=True)
class Pca:
    """Centre, loadings (one row per component) and component variances."""

    mean: np.ndarray
    parts: np.ndarray
    variances: np.ndarray

    def whiten(self, df: DataFrame, vector: str, out: str = "whitened") -> DataFrame:
        """Centred scores divided by their standard deviation."""
        return df.withColumn(out, self._matrix(self.parts / np.sqrt(self.variances)[:, None])(F.col(vector)))

    def reconstruct(self, df: DataFrame, vector: str, out: str = "reconstructed") -> DataFrame:
        """Project on the components and back."""
        return df.withColumn(out, self._matrix(self.parts.T @ self.parts, back=True)(F.col(vector)))

    def _matrix(self, m: np.ndarray, back: bool = False):
        mean = self.mean

        @F.pandas_udf("array<double>")
        def apply(s: pd.Series) -> pd.Series:
            if s.empty:
                return s
            y = (np.stack(s.to_numpy()).astype(float) - mean) @ m.T
            return pd.Series(list(y + mean if back else y))

        return apply


def fit_pca(df: DataFrame, vector: str, k: int) -> Pca:
    """Principal components from the covariance matrix.

    Only the p x p matrix reaches the driver. The sign of a component is arbitrary; it is set so
    that the largest loading is positive.
    """
    n, mean, gram = gram_moments(df, vector)
    values, vectors = np.linalg.eigh(gram / (n - 1))
    order = np.argsort(values)[::-1][:k]
    parts = vectors[:, order].T
    largest = np.abs(parts).argmax(axis=1)
    parts = parts * np.sign(parts[np.arange(len(parts)), largest])[:, None]
    return Pca(mean, parts, values[order])


def independent_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Walk the covariance columns in order and keep those that raise the rank."""
    n = {c: i for i, c in enumerate(cols)}
    cov = np.zeros((len(cols), len(cols)))
    for r in mean_cov(df, cols).collect():
        cov[n[r["col_i"]], n[r["col_j"]]] = cov[n[r["col_j"]], n[r["col_i"]]] = r["cov"]
    spread = np.sqrt(np.diag(cov))
    # Rank does not depend on units, its numerical test does.
    cov = cov / np.where(spread > 0, spread, 1)[:, None] / np.where(spread > 0, spread, 1)[None, :]
    kept: list[int] = []
    for i in range(len(cols)):
        if np.linalg.matrix_rank(cov[:, [*kept, i]], tol=1e-9) > len(kept):
            kept.append(i)
    return [cols[i] for i in kept]


def feature_clusters(df: DataFrame, vector: str, keep: int, components: int, seed: int = 157) -> list[int]:
    """Principal feature analysis (Lu et al. 2007): positions of the ``keep`` chosen entries.

    Entries are clustered by their loadings and the one nearest each cluster centre stays. The
    input of the clustering is one row per vector entry.
    """
    pca = fit_pca(df, vector, components)
    spark = df.sparkSession
    rows = [(i, [float(v) for v in pca.parts[:, i]]) for i in range(pca.parts.shape[1])]
    entries = spark.createDataFrame(rows, "pos int, loading array<double>").withColumn("features", array_to_vector("loading"))
    model = KMeans(k=keep, seed=seed, maxIter=50).fit(entries)
    centres = np.array(model.clusterCenters())
    nearest = {}
    for r in model.transform(entries).select("pos", "loading", "prediction").collect():
        gap = float(((np.array(r["loading"]) - centres[r["prediction"]]) ** 2).sum())
        nearest[r["prediction"]] = min(nearest.get(r["prediction"], (gap, r["pos"])), (gap, r["pos"]))
    return sorted(pos for _, pos in nearest.values())

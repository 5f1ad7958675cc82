"""Models fitted on Spark. Where the wanted algorithm has no built-in form the docstring names the difference."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions.maths import linear, sigmoid
from tabflow.operators import trees as forests
from tabflow.session import cut_lineage, spread

SEED = 157


def with_features(df: DataFrame, cols: Sequence[str] | str, name: str = "features") -> DataFrame:
    """Vector column from scalar columns, or from one array column."""
    if isinstance(cols, str):
        return df.withColumn(name, array_to_vector(F.col(cols).cast("array<double>")))
    return VectorAssembler(inputCols=list(cols), outputCol=name).transform(df)


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One-feature least squares, ``(slope, intercept)``, in one aggregate."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def linreg(df: DataFrame, label: str, features: str = "features") -> Model:
    """Ordinary least squares by the normal equations."""
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal", regParam=0.0).fit(df)


def logistic_cost(df: DataFrame, cols: Sequence[str], label: str, theta: Sequence[float], lam: float) -> DataFrame:
    """Regularised cost at ``theta`` for columns whose first is the intercept's ones; the intercept is free."""
    z = linear([F.col(c) for c in cols], list(theta))
    y = F.col(label).cast("double")
    loss = -y * F.log(sigmoid(z)) - (1 - y) * F.log(1 - sigmoid(z))
    penalty = lam * sum(float(t) ** 2 for t in theta[1:]) / 2
    return df.agg((F.avg(loss) + F.lit(penalty) / F.count(F.lit(1))).alias("cost"))


def logistic_gradient(df: DataFrame, cols: Sequence[str], label: str, theta: Sequence[float], lam: float) -> DataFrame:
    """Gradient of :func:`logistic_cost`, one row ``(position, gradient)`` per parameter."""
    z = linear([F.col(c) for c in cols], list(theta))
    error = sigmoid(z) - F.col(label).cast("double")
    rows = F.count(F.lit(1))
    parts = [F.avg(error * F.col(c)) + F.lit(lam * theta[i] if i else 0.0) / rows for i, c in enumerate(cols)]
    one = df.agg(F.array(*parts).alias("g"))
    return one.select(F.posexplode("g").alias("position", "gradient"))


def logreg_l2(df: DataFrame, label: str, lam: float = 1.0, features: str = "features", max_iter: int = 200) -> Model:
    """Same objective as :func:`logistic_cost`, minimised by the built-in optimiser."""
    return LogisticRegression(
        featuresCol=features, labelCol=label, regParam=lam / df.count(), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-10,
    ).fit(df)


def linear_svm(df: DataFrame, label: str, c: float = 1000.0, features: str = "features", max_iter: int = 200) -> Model:
    """Linear support vector classifier with cost ``c`` (hinge loss, L2)."""
    return LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (c * df.count()), standardization=False, maxIter=max_iter).fit(df)


@dataclass(frozen=True)
class RandomFourier:
    """Random Fourier features (Rahimi & Recht 2007): inner products approximate ``exp(-gamma |x-y|^2)``."""

    gamma: float
    dims: int
    size: int = 256
    seed: int = SEED

    def transform(self, df: DataFrame, vector: str, out: str = "features") -> DataFrame:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(scale=math.sqrt(2 * self.gamma), size=(self.dims, self.size))
        b = rng.uniform(0, 2 * math.pi, size=self.size)
        scale = math.sqrt(2 / self.size)

        @F.pandas_udf("array<double>")
        def lift(s: pd.Series) -> pd.Series:
            if s.empty:
                return s
            return pd.Series(list(scale * np.cos(np.stack(s.to_numpy()).astype(float) @ w + b)))

        return df.withColumn(out, array_to_vector(lift(F.col(vector))))


@dataclass(frozen=True)
class RbfSvm:
    """Kernel classifier: random Fourier features, then a linear one. Approximate by design."""

    lift: RandomFourier
    model: Model
    vector: str

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.lift.transform(df, self.vector, "__lifted"))
        return scored.withColumn("decision", vector_to_array("rawPrediction")[1]).drop("__lifted", "rawPrediction")


def rbf_svm(df: DataFrame, vector: str, label: str, c: float, gamma: float | str = "auto", size: int = 256, max_iter: int = 100) -> RbfSvm:
    """``gamma='auto'`` is one over the number of entries."""
    dims = df.select(F.size(vector)).first()[0]
    lift = RandomFourier(1.0 / dims if gamma == "auto" else float(gamma), dims, size)
    lifted = lift.transform(df, vector, "__lifted")
    return RbfSvm(lift, linear_svm(lifted, label, c, "__lifted", max_iter), vector)


def platt(scored: DataFrame, decision: str, label: str, out: str = "probability_of_0") -> DataFrame:
    """Probability of class 0 from a decision value, by a one-feature logistic fit."""
    base = with_features(scored, [decision], "__d")
    model = LogisticRegression(featuresCol="__d", labelCol=label, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c").fit(base)
    return model.transform(base).withColumn(out, vector_to_array("__p")[0]).drop("__d", "__p", "__r", "__c")


def extra_trees(df: DataFrame, label: str, count: int = 1200, subset: str | float = "all", depth: int = 10, bootstrap: bool = False, features: str = "features") -> forests.Forest:
    """Extremely randomised trees on whole rows, cuts drawn at random: :func:`tabflow.operators.trees.extra_trees`."""
    return forests.extra_trees(df, label, count, subset, depth, bootstrap, features, SEED)


def random_forest(df: DataFrame, label: str, trees: int = 100, depth: int = 1, features: str = "features", weight: str | None = None) -> Model:
    extra = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED, **extra).fit(df)


def gradient_boost_reg(df: DataFrame, label: str, rounds: int = 2000, rate: float = 0.01, share: float = 0.5, depth: int = 6, penalty: float = 0.01, features: str = "features") -> forests.Boosted:
    """Second-order boosting of squared errors; ``share`` of the columns is drawn per tree, of these per level, of these per node."""
    return forests.boost(df, label, 0, rounds, rate, depth, penalty, 1.0, share, share, share, features=features, seed=SEED)


def gradient_boost_clf(df: DataFrame, label: str, rounds: int = 500, rate: float = 0.01, depth: int = 3, features: str = "features") -> forests.Boosted:
    """Second-order boosting of all classes at once: a round fits one tree for each to the derivatives of the softmax loss."""
    classes = df.agg(F.max(label)).first()[0]
    if classes is None:
        raise ValueError("there is no row with a label")
    return forests.boost(df, label, max(2, int(classes) + 1), rounds, rate, depth, 1.0, 1e-3, features=features, seed=SEED)


def mlp(df: DataFrame, label: str, layers: Sequence[int], features: str = "features", max_iter: int = 100) -> Model:
    """Dense net with sigmoid hidden layers and softmax output; no dropout or batch normalisation."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=list(layers), seed=SEED, maxIter=max_iter).fit(df)


@dataclass(frozen=True)
class AdaBoost:
    """Rounds of (model, vote weight)."""

    rounds: list[tuple[Model, float]]
    classes: int
    errors: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``votes`` (array per class) and ``prediction`` (largest vote, first class on a tie)."""
        out = df.withColumn("votes", F.array(*[F.lit(0.0)] * self.classes))
        for model, alpha in self.rounds:
            out = _predict(model, out)
            out = out.withColumn("votes", F.transform("votes", lambda v, i: v + F.when(i == F.col("__pred").cast("int"), F.lit(alpha)).otherwise(F.lit(0.0)))).drop("__pred")
        return out.withColumn("prediction", (F.array_position("votes", F.array_max("votes")) - 1).cast("int"))


def _predict(model: Model, df: DataFrame) -> DataFrame:
    plain = model.copy({model.predictionCol: "__pred", model.rawPredictionCol: "", model.probabilityCol: ""})
    return plain.transform(df)


def adaboost(df: DataFrame, label: str, rounds: int = 10, rate: float = 1.0, depth: int = 1, trees: int = 0, features: str = "features", cut_every: int = 5) -> AdaBoost:
    """SAMME boosting of weighted trees, or of weighted forests with ``trees > 0``.

    A round is one weighted fit, one aggregate for its error and a new weight column. Scoring a
    row again with a few trees is cheaper than storing it, so the rows are written to the shared
    folder only every ``cut_every`` rounds; no round replays more models than that.
    """
    rows = df.select(features, F.col(label).cast("double").alias("__y"))
    n, classes = rows.agg(F.count(F.lit(1)), F.max("__y") + 1).first()
    classes = int(classes)
    rows = rows.withColumn("__w", F.lit(1.0 / n))
    kept: list[tuple[Model, float]] = []
    errors: list[float] = []
    for i in range(rounds):
        if trees:
            model = random_forest(rows, "__y", trees, depth, features, "__w")
        else:
            model = DecisionTreeClassifier(featuresCol=features, labelCol="__y", weightCol="__w", maxDepth=depth, seed=SEED + i).fit(rows)
        miss = (F.col("__pred") != F.col("__y")).cast("double")
        judged = _predict(model, rows).withColumn("__miss", miss).drop("__pred")
        wrong, total = judged.agg(F.sum(F.col("__w") * F.col("__miss")), F.sum("__w")).first()
        error = wrong / total
        errors.append(error)
        if error <= 0:
            kept.append((model, 1.0))
            break
        if error >= 1 - 1 / classes:
            if not kept:
                raise ValueError("the first base model is no better than chance")
            break
        alpha = rate * (math.log((1 - error) / error) + math.log(classes - 1))
        kept.append((model, alpha))
        grown = F.col("__w") * F.exp(F.lit(alpha) * F.col("__miss"))
        # The sum after growth follows from the error, so the weights are scaled in the same pass.
        after = total * ((1 - error) + error * math.exp(alpha))
        rows = judged.withColumn("__w", grown / F.lit(after)).drop("__miss")
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            rows = cut_lineage(rows)
    return AdaBoost(kept, classes, errors)


@dataclass(frozen=True)
class Centres:
    """Cluster centres of the best start, its cost (squared distances over all rows) and the costs of all starts."""

    centres: np.ndarray
    cost: float
    costs: list[float]
    scans: int
    features: str

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802
        return list(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, the nearest centre (the first on a tie); NULL for a NULL vector."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(s: pd.Series) -> pd.Series:
            known = s.notna().to_numpy()
            out = pd.Series([None] * len(s), dtype="Int32")
            if known.any():
                out[known] = _gaps(np.stack(s[known].to_numpy()).astype(float), centres).argmin(axis=1)
            return out

        return df.withColumn("prediction", nearest(F.when(F.col(self.features).isNotNull(), vector_to_array(self.features))))


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def _spread_start(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres drawn one by one, in proportion to the squared distance from those drawn before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    for _ in range(k - 1):
        gap = _gaps(x, x[chosen]).min(axis=1)
        chosen.append(int(rng.choice(len(x), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(x))))
    return x[chosen].copy()


def _step_sums(rows: DataFrame, centres: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan for all starts: sums and sizes of the clusters of every start, and its cost. ``centres`` is start by cluster by entry."""
    starts, k, dims = centres.shape
    flat = centres.reshape(-1, dims)
    step = max(1, cells // (starts * k))

    def run(batches):
        total = np.zeros((starts * k, dims + 2))
        for batch in batches:
            whole = np.stack(batch["x"].to_numpy()).astype(float) if len(batch) else np.zeros((0, dims))
            for lo in range(0, len(whole), step):
                x = whole[lo : lo + step]
                gaps = _gaps(x, flat).reshape(len(x), starts, k)
                near = gaps.argmin(axis=2)
                mine = np.zeros((len(x), starts, k))
                np.put_along_axis(mine, near[:, :, None], 1.0, axis=2)
                total[:, :dims] += mine.reshape(len(x), -1).T @ x
                total[:, dims] += mine.sum(axis=0).reshape(-1)
                total[:, dims + 1] += (mine * gaps).sum(axis=0).reshape(-1)
        yield pd.DataFrame({"cluster": np.arange(starts * k, dtype=np.int32), "part": list(total)})

    parts = rows.mapInPandas(run, "cluster int, part array<double>").select("cluster", F.posexplode("part").alias("i", "v"))
    out = np.zeros((starts * k, dims + 2))
    # As many rows as the centres have entries.
    for r in parts.groupBy("cluster", "i").agg(F.sum("v").alias("v")).collect():
        out[r.cluster, r.i] = r.v
    out = out.reshape(starts, k, dims + 2)
    return out[..., :dims], out[..., dims], out[..., dims + 1].sum(axis=1)


def kmeans(df: DataFrame, k: int = 2, starts: int = 20, max_iter: int = 500, features: str = "features", tol: float = 1e-4, sample: int = 2048) -> Centres:
    """Lloyd's steps from several starts; the start of least cost wins, the first on a tie.

    A scan serves all starts that still move: tasks return sums and sizes per start and cluster, so the number of scans is that of the slowest
    start, whatever their number. A start is done when no centre moves further than ``tol``. Starts are drawn from the ``sample`` rows that a hash of
    the vector puts first; every step reads all rows. A cluster without rows keeps its centre. NULL vectors take no part; no other rows is an error.
    """
    # Written after it was spread: every scan reads its share, and none shuffles the rows again.
    rows = cut_lineage(spread(df.filter(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"))))
    drawn = rows.orderBy(F.xxhash64("x"), "x").limit(sample).collect()
    if not drawn:
        raise ValueError("there is no row with a vector")
    first = np.array([r.x for r in drawn], float)
    centres = np.stack([_spread_start(first, k, SEED + i) for i in range(starts)])
    moving, scans = np.arange(starts), 0
    while len(moving) and scans < max_iter:
        sums, sizes, _ = _step_sums(rows, centres[moving])
        scans += 1
        new = np.where(sizes[..., None] > 0, sums / np.maximum(sizes, 1)[..., None], centres[moving])
        moved = np.sqrt(((new - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
        centres[moving] = new
        moving = moving[moved > tol]
    costs = _step_sums(rows, centres)[2]
    best = int(costs.argmin())
    return Centres(centres[best], float(costs[best]), [float(c) for c in costs], scans + 1, features)


def majority_label(scored: DataFrame, cluster: str, label: str) -> DataFrame:
    """Most frequent class of each cluster, the lowest on a tie: ``(cluster, prediction_label)``."""
    counts = scored.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), label)).alias("b")
    return counts.groupBy(cluster).agg(best).select(cluster, F.col(f"b.{label}").alias("prediction_label"))


def kmeans_step(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """One Lloyd step from fixed centres: ``(cluster, n, cols...)`` with the new centres."""

    def gap(centre: Sequence[float]) -> Column:
        squares = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, centre, strict=True)]
        return sum(squares[1:], squares[0])

    nearest = F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))["cluster"]
    return df.groupBy(nearest.alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""Scores of classifiers and regressors; each is one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions.maths import clip, clip_log, safe_ratio
from tabflow.operators.rows import min_rank

# Class weights of the light-curve loss. Classes not named weigh 1; class 99 does
# not occur in training data.
CLASS_WEIGHTS = {15: 2.0, 64: 2.0, 99: 2.0}


def _hits(true: str, pred: Column, t: int, p: int) -> Column:
    return F.sum(((F.col(true) == t) & (pred == p)).cast("long"))


def binary_counts(df: DataFrame, true: str, pred: str | Column) -> DataFrame:
    """One row ``(tp, tn, fp, fn)``."""
    p = F.col(pred) if isinstance(pred, str) else pred
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return df.agg(*[F.coalesce(_hits(true, p, *tp), F.lit(0)).alias(n) for n, tp in cells.items()])


def _f1_columns() -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.try_divide(F.lit(2.0) * precision * recall, precision + recall),
    }


def f1_binary(df: DataFrame, true: str, pred: str | Column) -> DataFrame:
    """Counts with precision, recall and F1; a 0/0 gives NULL."""
    return binary_counts(df, true, pred).withColumns(_f1_columns())


def apply_threshold(df: DataFrame, true: str, p: str, epsilon: float) -> DataFrame:
    """F1 of calling every row below ``epsilon`` positive."""
    return f1_binary(df, true, (F.col(p) < F.lit(epsilon)).cast("int"))


def threshold_sweep(df: DataFrame, true: str, p: str, steps: int = 1000) -> DataFrame:
    """Best F1 over ``steps`` thresholds from min to max, rows below being positive.

    One pass: each row falls in the first threshold that calls it positive, and running totals
    over at most ``steps + 1`` buckets give every threshold its counts. The first best threshold
    wins, and the counts returned are its own. As in ``apply_threshold``, a NaN score is never below a threshold, and
    rows with a NULL do not count.
    """
    rows = df.select(F.col(true).alias("__y"), F.col(p).cast("double").alias("__p")).filter("__y is not null and __p is not null")
    real = F.when(~F.isnan("__p"), F.col("__p"))
    low, high, n, positives = rows.agg(F.min(real), F.max(real), F.count(F.lit(1)), F.sum(F.col("__y").cast("long"))).first()
    names = ["epsilon", "tp", "tn", "fp", "fn", "precision", "recall", "f1"]
    if low is None or low == high:
        return df.sparkSession.createDataFrame([], "epsilon double, tp long, tn long, fp long, fn long, precision double, recall double, f1 double")
    step = (high - low) / steps

    def edge(i: Column) -> Column:
        return F.lit(low) + i * F.lit(step)

    guess = F.floor((F.col("__p") - F.lit(low)) / F.lit(step)).cast("long")
    # Rounding may put the guess off by one either way; the strict comparison decides.
    first = F.when(F.col("__p") < edge(guess), guess).when(F.col("__p") < edge(guess + 1), guess + 1).otherwise(guess + 2)
    first = F.when((guess > 0) & (F.col("__p") < edge(guess - 1)), guess - 1).otherwise(first)
    tally = rows.filter(~F.isnan("__p")).groupBy(F.least(first, F.lit(steps)).alias("i")).agg(
        F.sum((F.col("__y") == 1).cast("long")).alias("pos"), F.sum((F.col("__y") == 0).cast("long")).alias("neg")
    )
    grid = df.sparkSession.range(steps).select(F.col("id").alias("i"))
    full = grid.join(F.broadcast(tally), "i", "left").na.fill(0, ["pos", "neg"])
    upto = Window.partitionBy().orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    counted = full.select("i", F.sum("pos").over(upto).alias("tp"), F.sum("neg").over(upto).alias("fp"))
    scored = counted.withColumns({"fn": F.lit(positives) - F.col("tp"), "tn": F.lit(n - positives) - F.col("fp")})
    scored = scored.withColumns(_f1_columns()).withColumn("epsilon", edge(F.col("i")))
    best = scored.filter(F.col("f1").isNotNull()).orderBy(F.col("f1").desc(), "i").limit(1)
    return best.select(*names)


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: Sequence) -> DataFrame:
    """``(y_true, y_pred, n)`` for every pair of the given labels, zeros included."""
    labels = list(labels)
    named = df.filter(F.col(true).isin(labels) & F.col(pred).isin(labels))
    counts = named.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    kind = df.schema[true].dataType.simpleString()
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], f"y_true {kind}, y_pred {kind}")
    # No more counts than label pairs.
    return grid.join(F.broadcast(counts), ["y_true", "y_pred"], "left").na.fill(0, ["n"])


def f1_multiclass(df: DataFrame, true: str, pred: str, average: str) -> DataFrame:
    """Micro- or support-weighted F1 as one row ``(f1)``; a class without hits counts as 0."""
    if average not in ("micro", "weighted"):
        raise ValueError("average must be 'micro' or 'weighted'")
    # One partial count per (true, predicted) pair is all that is shuffled.
    pairs = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(
        F.array(
            F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("tp")),
        )
    )
    by_class = pairs.select(sides.alias("s")).select("s.*").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "called", "tp")])
    if average == "micro":
        return by_class.agg(safe_ratio(F.lit(2) * F.sum("tp"), F.sum("support") + F.sum("called")).alias("f1"))
    own = F.coalesce(safe_ratio(F.lit(2) * F.col("tp"), F.col("support") + F.col("called")), F.lit(0.0))
    return by_class.agg(safe_ratio(F.sum(own * F.col("support")), F.sum("support")).alias("f1"))


def accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))


def weighted_logloss(df: DataFrame, true: str, p_true: str, weights: dict | None = None) -> DataFrame:
    """Class-weighted log loss from the probability given to the true class.

    The mean log probability of each class seen is weighted and divided by the sum of weights.
    Probabilities are clipped, rows are not renormalised.
    """
    weights = CLASS_WEIGHTS if weights is None else weights
    by_class = df.groupBy(F.col(true).alias("c")).agg(F.avg(clip_log(F.col(p_true))).alias("m"))
    w = F.lit(1.0)
    for c, v in weights.items():
        w = F.when(F.col("c") == F.lit(c), F.lit(float(v))).otherwise(w)
    return by_class.agg((-F.sum(w * F.col("m")) / F.sum(w)).alias("loss"))


def binary_crossentropy(df: DataFrame, true: str, p: str) -> DataFrame:
    q = clip(F.col(p))
    y = F.col(true).cast("double")
    return df.agg((-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("loss"))


def categorical_crossentropy(df: DataFrame, p_true: str) -> DataFrame:
    return df.agg((-F.avg(clip_log(F.col(p_true)))).alias("loss"))


def regression_scores(df: DataFrame, y: str, pred: str) -> DataFrame:
    """``(mse, rmse, r2)`` with ``r2 = 1 - SSE / SST``."""
    gap = F.col(y) - F.col(pred)
    mse = F.avg(gap * gap)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"))


def msle(df: DataFrame, y: str, pred: str) -> DataFrame:
    gap = F.log1p(F.col(y)) - F.log1p(F.col(pred))
    return df.agg(F.avg(gap * gap).alias("msle"))


def best_worst(df: DataFrame, score: str, ordinal: str, cols: Sequence[str]) -> DataFrame:
    """Best and worst configuration, the last one on a tie: ``(which, score, ordinal, cols...)``."""
    row = F.struct(F.col(score).alias("score"), F.col(ordinal).alias("ordinal"), *cols)
    best = F.max_by(row, F.struct(score, ordinal))
    worst = F.max_by(row, F.struct(-F.col(score), F.col(ordinal)))
    one = df.agg(best.alias("b"), worst.alias("w"))
    both = F.array(F.struct(F.lit("best").alias("which"), F.col("b").alias("r")), F.struct(F.lit("worst").alias("which"), F.col("w").alias("r")))
    return one.select(F.explode(both).alias("x")).select("x.which", "x.r.*")


def best_first(df: DataFrame, score: str, ordinal: str) -> DataFrame:
    """The best row, the first one on a tie."""
    return df.orderBy(F.col(score).desc(), ordinal).limit(1)


def grid_summary(df: DataFrame, config: str, score: str, weight: str | None = None, **kw) -> DataFrame:
    """Mean, population deviation and min-rank of split scores per configuration.

    ``weight`` names the size of each split, for means over rows instead of splits.
    """
    if weight is None:
        found = [F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score")]
    else:
        w, s = F.col(weight), F.col(score)
        mean = F.sum(w * s) / F.sum(w)
        square = F.sum(w * s * s) / F.sum(w) - mean * mean
        found = [mean.alias("mean_score"), F.sqrt(F.greatest(F.lit(0.0), square)).alias("std_score")]
    means = df.groupBy(config).agg(*found)
    # Equal scores summed in another order must still tie.
    ranked = min_rank(means.withColumn("__m", F.round("mean_score", 12)), "__m", "rank_score", **kw)
    return ranked.drop("__m")

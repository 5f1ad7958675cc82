"""Queries that fit models.

SQL cannot express a fit, so a query returns statements about the whole fitted result that SQL can check: sizes of the
held-out part, better than the majority class or the mean there, a zero gradient at the optimum, fixed centres, exact shares.
Labels are functions of the vectors, so that there is something to learn. Where a setting below is smaller than the operator's
default, README names the measured time of a tree, round or iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators import anomaly, metrics, models, neighbors, rows, tune
from tabflow.operators.models import with_features
from tabflow.operators.scale import fit_pca
from tabflow.plans.measures import _SCALED, scaled_sensors
from tabflow.plans.registry import R, Tables, query, rounded
from tabflow.session import attach, cut_lineage, spread

DIMS = 64
CLASSES = 5


# Settings of the queries.
FOREST_TREES, TREE_DEPTH = 100, 6
EXTRA_TREES, EXTRA_DEPTH, CURVE_TREES = 1200, 10, 100
BOOST_ROUNDS, ADA_ROUNDS = 20, 10
GRID_FOLDS = 10
SVM_ITERATIONS, NET_ITERATIONS = 100, 100
TEST_SHARE = 0.2

# Labels as SQL, over the entries of a vector.
HALF = "cast(pixels[1] > 0 as integer)"
RING = "cast(pixels[1] * pixels[1] + pixels[2] * pixels[2] > 0.02 as integer)"
FIVE = "cast(case greatest(pixels[1], pixels[2], pixels[3], pixels[4], pixels[5]) when pixels[1] then 0 when pixels[2] then 1 when pixels[3] then 2 when pixels[4] then 3 else 4 end as integer)"


def images(t: Tables) -> DataFrame:
    """Vectors with a two-class label, one that no plane separates, and a five-class one; a fifth is marked as test rows."""
    p = [F.col("pixels")[i] for i in range(5)]
    data = with_features(t.image, "pixels").withColumns({
        "half": (p[0] > 0).cast("int"),
        "ring": (p[0] * p[0] + p[1] * p[1] > 0.02).cast("int"),
        "five": F.expr("case greatest(pixels[0], pixels[1], pixels[2], pixels[3], pixels[4]) when pixels[0] then 0 when pixels[1] then 1 when pixels[2] then 2 when pixels[3] then 3 else 4 end"),
    })
    return rows.split_random(data, "image_id", TEST_SHARE)


def split_sql(label: str) -> str:
    """The rows of ``images`` with one label, as SQL."""
    return f"""(select image_id, {label} as y, case when row_number() over (order by md5(concat(cast(image_id as varchar), '157')))
    <= ceil({TEST_SHARE} * (select count(*) from image)) then 1 else 0 end as is_test from image)"""


def held_out_sql(label: str) -> str:
    test = f"(select y, count(*) as n from {split_sql(label)} where is_test = 1 group by y)"
    return f"""select (select count(*) from {split_sql(label)} where is_test = 0) as n_train, cast(sum(n) as bigint) as n_test,
    {R('max(n) / sum(n)')} as majority, true as beats_majority from {test}"""


def held_out(scored: DataFrame, label: str) -> DataFrame:
    """Sizes, the share of the largest class among the test rows, and whether more of them than that were predicted right."""
    test = F.col("is_test") == 1
    sizes = scored.groupBy("is_test", label).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction").cast("int") == F.col(label)).cast("int")).alias("hits"))
    own = F.when(test, F.col("n"))
    out = sizes.agg(F.sum(F.when(~test, F.col("n"))).alias("n_train"), F.sum(own).alias("n_test"), F.max(own).alias("most"), F.sum(F.when(test, F.col("hits"))).alias("hits"))
    return rounded(out.select("n_train", "n_test", (F.col("most") / F.col("n_test")).alias("majority"), (F.col("hits") > F.col("most")).alias("beats_majority")))


def on_held_out(t: Tables, label: str, fit) -> DataFrame:
    """Fit on the training rows, judge on the test rows."""
    data = cut_lineage(images(t))
    return held_out(fit(data.filter("is_test = 0")).transform(data), label)


def documents(t: Tables) -> DataFrame:
    """Labelled documents with numeric features of the text."""
    words = F.size(F.split("text", r"\s+"))
    text = t.documents.select(
        "doc_id", F.log1p(F.col("n_chars")).alias("log_chars"), F.log1p(words).alias("log_words"),
        (F.col("n_chars") / F.greatest(words, F.lit(1))).alias("chars_per_word"),
    )
    return with_features(text.join(t.labels, "doc_id"), ["log_chars", "log_words", "chars_per_word"])


@query(
    "linreg_many",
    f"""select row_key, {R('my + b1 * (s1 - m1) + b3 * (s3 - m3)')} as prediction from {_SCALED}, (select m1, m3, my,
    (c1y * c33 - c3y * c13) / (c11 * c33 - c13 * c13) as b1, (c3y * c11 - c1y * c13) / (c11 * c33 - c13 * c13) as b3 from (select avg(s1) as m1,
    avg(s3) as m3, avg(s2) as my, var_pop(s1) as c11, var_pop(s3) as c33, covar_pop(s1, s3) as c13, covar_pop(s1, s2) as c1y,
    covar_pop(s3, s2) as c3y from {_SCALED}))""",
)
def linreg_many(t: Tables) -> DataFrame:
    data = with_features(scaled_sensors(t), ["s1", "s3"])
    return rounded(models.linreg(data, "s2").transform(data).select("row_key", "prediction"))


@query("logreg_l2", "select count(*) as n_rows, true as zero_gradient, true as costs_less from (select l.doc_id from labels l join documents d on l.doc_id = d.doc_id)")
def logreg_l2(t: Tables) -> DataFrame:
    """The gradient of the regularised cost is zero at the fitted parameters, and the cost is below that of all zeros."""
    columns = ["ones", "log_chars", "log_words", "chars_per_word"]
    data = cut_lineage(documents(t).withColumn("ones", F.lit(1.0)))
    model = models.logreg_l2(data, "quality")
    theta = [float(model.intercept), *map(float, model.coefficients)]
    slope = models.logistic_gradient(data, columns, "quality", theta, 1.0).agg(F.max(F.abs("gradient"))).first()[0]
    cost = [models.logistic_cost(data, columns, "quality", p, 1.0).first()[0] for p in (theta, [0.0] * 4)]
    return data.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(bool(slope < 1e-4)).alias("zero_gradient"), F.lit(bool(cost[0] < cost[1])).alias("costs_less"))


@query("linear_svm", held_out_sql(HALF))
def linear_svm(t: Tables) -> DataFrame:
    return on_held_out(t, "half", lambda train: models.linear_svm(train, "half", 1000.0, max_iter=SVM_ITERATIONS))


@query("rbf_svm", held_out_sql(RING))
def rbf_svm(t: Tables) -> DataFrame:
    """A class inside a ring of the first two entries, which no plane separates."""
    data = cut_lineage(images(t).withColumn("plane", F.transform(F.slice("pixels", 1, 2), lambda v: v * 8)))
    return held_out(models.rbf_svm(data.filter("is_test = 0"), "plane", "ring", 10.0, max_iter=SVM_ITERATIONS).transform(data), "ring")


def falling(df: DataFrame, x: str, y: str, ranges: int = 200) -> bool:
    """Whether ``y`` never rises with ``x``: inside ranges of ``x``, whose rows are compared in order, and from range to range."""
    least, most = df.agg(F.min(x), F.max(x)).first()
    width = max((most - least) / ranges, 1e-300) if least is not None else 1.0
    cut = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.floor((F.col(x) - F.lit(least)) / F.lit(width)).alias("range"))
    inside = cut.select((F.lag("y").over(Window.partitionBy("range").orderBy("x", F.desc("y"))) - F.col("y")).alias("fall")).agg(F.min("fall")).first()[0]
    # A row for each range.
    ends = cut.groupBy("range").agg(F.min("y").alias("low"), F.max("y").alias("high")).orderBy("range").collect()
    return bool((inside is None or inside >= 0) and all(a.low >= b.high for a, b in zip(ends[:-1], ends[1:], strict=True)))


@query("platt_probability", f"select count(*) as n_rows, {R('avg(1 - y)')} as share_of_0, true as calibrated, true as falls_with_decision from {split_sql(HALF)}")
def platt_probability(t: Tables) -> DataFrame:
    """Probabilities from margins of other folds: their mean is the share of the class, and they fall where the margin rises."""
    data = rows.stratified_folds(images(t).drop("is_test"), "image_id", "half", 3)
    margins = tune.out_of_fold_model(data, "image_id", "fold", 3, lambda train: models.rbf_svm(train, "pixels", "half", 10.0, max_iter=SVM_ITERATIONS))
    scored = cut_lineage(models.platt(cut_lineage(margins), "decision", "half").select("half", "decision", "probability_of_0"))
    falls = falling(scored, "decision", "probability_of_0")
    out = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(1 - F.col("half")).alias("share_of_0"), F.avg("probability_of_0").alias("mean"))
    out = out.withColumn("calibrated", F.abs(F.col("mean") - F.col("share_of_0")) < 1e-3).drop("mean")
    return rounded(out.withColumn("falls_with_decision", F.lit(falls)))


@query("extra_trees", held_out_sql(FIVE))
def extra_trees(t: Tables) -> DataFrame:
    return on_held_out(t, "five", lambda train: models.extra_trees(train, "five", EXTRA_TREES, "all", EXTRA_DEPTH))


@query("random_forest", held_out_sql(FIVE))
def random_forest(t: Tables) -> DataFrame:
    return on_held_out(t, "five", lambda train: models.random_forest(train, "five", FOREST_TREES, TREE_DEPTH))


@query("adaboost", held_out_sql(HALF))
def adaboost(t: Tables) -> DataFrame:
    return on_held_out(t, "half", lambda train: models.adaboost(train, "half", ADA_ROUNDS, 1.0, 1))


@query("gradient_boost_clf", held_out_sql(FIVE))
def gradient_boost_clf(t: Tables) -> DataFrame:
    """Five classes at once."""
    return on_held_out(t, "five", lambda train: models.gradient_boost_clf(train, "five", BOOST_ROUNDS, 0.1, 3))


@query(
    "gradient_boost_reg",
    "select count(*) as n_rows, true as beats_mean from sensor_row where row_key in (select row_key from (select row_key, row_number() over (order by md5(concat(cast(row_key as varchar), '157'))) as i, count(*) over () as n from (select distinct row_key from sensor_row)) where i <= ceil(0.2 * n))",
)
def gradient_boost_reg(t: Tables) -> DataFrame:
    """A product of two sensors on held-out keys: the squared error is less than half that of the mean."""
    data = with_features(spread(scaled_sensors(t)), ["s1", "s3", "s4"]).withColumn("load", F.col("s1") * F.col("s3"))
    keys = rows.split_random(data.select("row_key").distinct(), "row_key", TEST_SHARE)
    data = cut_lineage(data.join(keys, "row_key"))
    # All of the operator's defaults: 2000 rounds at rate 0.01, half of the columns for a tree, of these for a level, of these for a node.
    scored = models.gradient_boost_reg(data.filter("is_test = 0"), "load").transform(data.filter("is_test = 1"))
    gap = F.col("load") - F.col("prediction")
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), (F.avg(gap * gap) < F.var_pop("load") / 2).alias("beats_mean"))


@query("mlp_clf", held_out_sql(FIVE))
def mlp_clf(t: Tables) -> DataFrame:
    return on_held_out(t, "five", lambda train: models.mlp(train, "five", [DIMS, 32, CLASSES], max_iter=NET_ITERATIONS))


@query("kmeans", "select count(*) as n_rows, cast(2 as bigint) as n_clusters, true as centres_stay, true as nearest_centre from image")
def kmeans(t: Tables) -> DataFrame:
    """Every row is with its nearest centre, and every centre is the mean of its rows: another step changes nothing."""
    data = cut_lineage(images(t))
    model = models.kmeans(data, 2)
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    scored = model.transform(data).select("prediction", "pixels")
    means = scored.select("prediction", F.posexplode("pixels").alias("i", "v")).groupBy("prediction", "i").agg(F.avg("v").alias("m")).collect()
    stay = max(abs(r.m - centres[r.prediction][r.i]) for r in means) < 1e-3
    gaps = F.array(*[F.aggregate(F.zip_with("pixels", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres])
    near = F.element_at(gaps, F.col("prediction") + 1) <= F.array_min(gaps) + 1e-6
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("prediction").alias("n_clusters"), F.lit(bool(stay)).alias("centres_stay"), F.bool_and(near).alias("nearest_centre"))


@query("reconstruction_anomaly", "select count(*) as n_rows, true as error_is_left_variance, true as flags_by_error from image")
def reconstruction_anomaly(t: Tables) -> DataFrame:
    """The mean error is the variance of the components left out; the flag is the error above 0.84."""
    kept, every = 8, fit_pca(t.image, "pixels", DIMS)
    scored = anomaly.reconstruction_error(t.image, "pixels", kept)
    scored = scored.select("reconstruction_error", (F.col("reconstruction_error") > 0.84).alias("is_outlier"))
    n = t.image.count()
    left = float(every.variances[kept:].sum()) * (n - 1) / n / DIMS
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), (F.abs(F.avg("reconstruction_error") - F.lit(left)) < 1e-9).alias("error_is_left_variance"),
        F.bool_and(F.col("is_outlier") == (F.col("reconstruction_error") > 0.84)).alias("flags_by_error"))


@query("isolation_forest", "select count(*) as n_rows, true as share_holds, true as far_is_odd from events")
def isolation_forest(t: Tables) -> DataFrame:
    """At most the wanted share is called odd, ties aside all of it; rows far from the mean score higher than the rest."""
    data = spread(t.light_curve_obs.select("obs_id", "flux", F.array("flux", "flux_err", "mjd").alias("v")))
    forest = anomaly.isolation_forest(data, "obs_id", "v", 100)
    flagged = cut_lineage(anomaly.flag_share(data.select("obs_id", "flux", forest.score("v").alias("score")), "score", 0.18))
    mean, sd = flagged.agg(F.avg("flux"), F.stddev("flux")).first()
    far = F.abs(F.col("flux") - F.lit(mean)) > 2.5 * sd
    n, odd = F.count(F.lit(1)), F.sum("is_outlier")
    return flagged.agg(n.alias("n_rows"), ((odd <= F.ceil(0.18 * n)) & (odd >= 0.16 * n)).alias("share_holds"), (F.avg(F.when(far, F.col("score"))) > F.avg(F.when(~far, F.col("score")))).alias("far_is_odd"))


@query("one_class_boundary", "select count(*) as n_rows, cast(ceil(0.2 * count(*)) - 1 as bigint) as n_outlier, true as by_margin from image")
def one_class_boundary(t: Tables) -> DataFrame:
    """The boundary passes through the row of the wanted rank: one less than the share is outside."""
    scored = anomaly.one_class_boundary(t.image, "pixels", 0.2).transform(t.image, "pixels")
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("is_outlier").alias("n_outlier"), F.bool_and((F.col("margin") < 0) == (F.col("is_outlier") == 1)).alias("by_margin"))


@query("grid_search", "select cast(i as integer) as config_id, true as mean_holds, true as deviation_holds, true as rank_holds, true as best_beats_chance from range(8) r(i)")
def grid_search(t: Tables) -> DataFrame:
    """Means, deviations and ranks of the table follow from its split scores; the best configuration does better than chance."""
    folded = rows.stratified_folds(images(t).drop("is_test"), "image_id", "five", GRID_FOLDS)
    configs = [{"trees": n, "subset": s, "depth": d} for n in (10, 20) for s in ("sqrt", "all") for d in (5, 10)]
    table = tune.forest_grid(folded, "fold", GRID_FOLDS, "five", configs)
    scores = [F.col(f"split{i}_test_score") for i in range(GRID_FOLDS)]
    mean = sum(scores[1:], scores[0]) / GRID_FOLDS
    variance = sum(((s - mean) * (s - mean) for s in scores[1:]), (scores[0] - mean) * (scores[0] - mean)) / GRID_FOLDS
    # One row for each configuration.
    rank = F.rank().over(Window.orderBy(F.desc(F.round("mean_test_score", 12))))
    return table.select(
        "config_id", (F.abs(mean - F.col("mean_test_score")) < 1e-9).alias("mean_holds"), (F.abs(F.sqrt(variance) - F.col("std_test_score")) < 1e-9).alias("deviation_holds"),
        (rank == F.col("rank_test_score")).alias("rank_holds"), ((F.col("rank_test_score") > 1) | (F.col("mean_test_score") > 0.4)).alias("best_beats_chance"))


@query("param_sweep", "select cast(9 as bigint) as n_configs, true as in_order, true as best_is_most, true as scores_are_shares")
def param_sweep(t: Tables) -> DataFrame:
    data = cut_lineage(images(t))
    train, test = data.filter("is_test = 0"), data.filter("is_test = 1")

    def run(c: dict) -> float:
        scored = models.rbf_svm(train, "pixels", "half", c["C"], c["gamma"], 128, 30).transform(test)
        return metrics.accuracy(scored, "half", "prediction").first()[0]

    table = cut_lineage(tune.param_sweep(t.spark, [{"gamma": g, "C": c} for g in (0.01, 0.1, 1.0) for c in (0.1, 1.0, 10.0)], run))
    best = metrics.best_worst(table, "score", "ordinal", ["params"])
    top = table.agg(F.max("score")).first()[0]
    has_best = any(top in tuple(r) for r in best.collect())
    return table.agg(
        F.count(F.lit(1)).alias("n_configs"), (F.max("ordinal") - F.min("ordinal") + 1 == F.count_distinct("ordinal")).alias("in_order"), F.lit(bool(has_best)).alias("best_is_most"),
        F.bool_and(F.col("score").between(0, 1)).alias("scores_are_shares"))


@query("pca_neighbor_sweep", "select cast(i as integer) as config_id, true as mean_holds, true as rank_holds, true as better_than_chance from range(4) r(i)")
def pca_neighbor_sweep(t: Tables) -> DataFrame:
    """Components of the vectors x neighbours, F1 averaged over three folds; components are fitted on the training folds only."""
    folded = rows.stratified_folds(images(t).select("image_id", "pixels", "half"), "image_id", "half", 3)

    def run(train: DataFrame, test: DataFrame, c: dict) -> float | None:
        pca = fit_pca(train, "pixels", c["components"])
        known, asked = (cut_lineage(pca.whiten(part, "pixels")) for part in (train, test))
        near = neighbors.knn(known, asked, "image_id", "whitened", c["neighbors"])
        voted = neighbors.classify(near, known, "image_id", "half").withColumnRenamed("query_id", "image_id")
        return metrics.f1_binary(voted.join(asked.select("image_id", "half"), "image_id"), "half", "prediction").first()["f1"]

    table = tune.fold_sweep(folded, "fold", 3, [{"components": n, "neighbors": k} for n in (16, 64) for k in (5, 25)], run)
    mean = (F.col("fold0") + F.col("fold1") + F.col("fold2")) / 3
    rank = F.rank().over(Window.orderBy(F.desc(F.round("mean_score", 12))))
    return table.select(
        "config_id", (F.abs(mean - F.col("mean_score")) < 1e-12).alias("mean_holds"), (rank == F.col("rank")).alias("rank_holds"), (F.col("mean_score") > 0.4).alias("better_than_chance"))


@query(
    "light_curve_classes",
    """select y_true, count(*) as n_test, true as loss_is_positive, true as micro_is_accuracy from (select cast(dense_rank() over (order by target) - 1 as integer) as y_true,
    row_number() over (partition by target order by md5(concat(cast(object_id as varchar), '157'))) as i, count(*) over (partition by target) as n
    from object_meta where object_id in (select object_id from light_curve_obs)) where i <= ceil(0.1 * n) group by 1""",
)
def light_curve_classes(t: Tables) -> DataFrame:
    """Five classes, trained on nine tenths: rows of the confusion matrix, weighted loss, micro and weighted F1 on the rest."""
    from tabflow.plans.pipelines import BANDS, light_curve_features

    table = light_curve_features(t.light_curve_obs, t.object_meta, BANDS, "new").na.fill(0.0)
    names = [c for c in table.columns if c not in ("object_id", "target")]
    # A row for each class.
    classes = table.select("target").distinct().withColumn("label", (F.dense_rank().over(Window.orderBy("target")) - 1).cast("int"))
    coded = with_features(attach(table, classes, ["target"]), names)
    split = cut_lineage(rows.split_stratified(coded.select("object_id", "label", "features"), "object_id", "label", 0.1))
    model = models.extra_trees(split.filter("is_test = 0"), "label", CURVE_TREES, "all", 8)
    scored = cut_lineage(model.transform(split.filter("is_test = 1")).select("label", F.col("prediction").cast("int").alias("p"), F.get("probability", F.col("label")).alias("p_true")))
    loss = metrics.weighted_logloss(scored, "label", "p_true").first()["loss"]
    micro = metrics.f1_multiclass(scored, "label", "p", "micro").first()["f1"]
    hits = metrics.accuracy(scored, "label", "p").first()[0]
    weighted = metrics.f1_multiclass(scored, "label", "p", "weighted").first()["f1"]
    matrix = metrics.confusion_matrix(scored, "label", "p", range(5))
    fine = bool(loss > 0 and 0 <= weighted <= 1)
    return matrix.groupBy("y_true").agg(F.sum("n").alias("n_test")).filter("n_test > 0").select("y_true", "n_test", F.lit(fine).alias("loss_is_positive"), F.lit(bool(abs(micro - hits) < 1e-12)).alias("micro_is_accuracy"))

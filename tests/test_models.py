"""Metrics by hand, models by their defining properties, files by round trip."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabflow.operators import anomaly, images, metrics, models, rows, tune
from tabflow.session import attach, fresh_path, release, work_dir
from tabflow.sources import tables as io


def binary(spark, n=700, seed=1, ties=False):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        p = rng.gauss(0.4 if y else 0.6, 0.2)
        data.append((i, y, round(p, 1) if ties else p))
    return data, spark.createDataFrame(data, "id long, y int, p double").repartition(4)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("steps", [7, 1000])
def test_sweep_equals_brute_force(spark, ties, steps):
    data, df = binary(spark, ties=ties)
    ps = [p for _, _, p in data]
    low, step = min(ps), (max(ps) - min(ps)) / steps
    best = None
    for i in range(steps):
        e = low + i * step
        tp = sum(y == 1 and p < e for _, y, p in data)
        fp = sum(y == 0 and p < e for _, y, p in data)
        fn = sum(y == 1 and p >= e for _, y, p in data)
        if tp:
            f1 = 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))
            if best is None or f1 > best[0] + 1e-15:
                best = (f1, e, tp, fp, fn)
    got = metrics.threshold_sweep(df, "y", "p", steps).first()
    assert (got["epsilon"], got["tp"], got["fp"], got["fn"]) == best[1:]
    again = metrics.apply_threshold(df, "y", "p", got["epsilon"]).first()
    assert (again["tp"], again["tn"], again["f1"]) == (got["tp"], got["tn"], got["f1"])


def test_sweep_of_constant_scores_is_empty(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.threshold_sweep(df, "y", "p").count() == 0


def test_f1_of_nothing_is_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = metrics.f1_binary(df, "y", "p").first()
    assert (r["tp"], r["tn"], r["f1"], r["precision"]) == (0, 2, None, None)


def test_logloss_by_hand(spark):
    df = spark.createDataFrame([(15, 0.5), (15, 0.25), (90, 1.0), (90, 0.0)], "c int, p double")
    want = -(2 * (math.log(0.5) + math.log(0.25)) / 2 + (math.log(1 - 1e-15) + math.log(1e-15)) / 2) / 3
    assert metrics.weighted_logloss(df, "c", "p").first()[0] == pytest.approx(want)


def test_multiclass_f1_with_class_never_called(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    f = [2 * 1 / 3, 2 * 1 / 4, 0.0]
    assert metrics.f1_multiclass(df, "y", "p", "weighted").first()[0] == pytest.approx((2 * f[0] + f[1] + f[2]) / 4)
    assert metrics.f1_multiclass(df, "y", "p", "micro").first()[0] == 0.5


def test_confusion_matrix_lists_zeros(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (9, 0)], "y int, p int")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(df, "y", "p", [0, 1]).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 0}


def test_best_worst_and_first_on_ties(spark):
    df = spark.createDataFrame([(0, 0.5, "a"), (1, 0.9, "b"), (2, 0.9, "c"), (3, 0.5, "d")], "i int, s double, c string")
    got = {r["which"]: r["c"] for r in metrics.best_worst(df, "s", "i", ["c"]).collect()}
    assert got == {"best": "c", "worst": "d"}
    assert metrics.best_first(df, "s", "i").first()["c"] == "b"


def test_grid_summary_weighted(spark):
    df = spark.createDataFrame([(1, 0.5, 10.0), (1, 1.0, 30.0), (2, 0.875, 1.0), (2, 0.875, 9.0)], "c int, s double, w double")
    got = {r["c"]: r for r in metrics.grid_summary(df, "c", "s", "w").collect()}
    assert got[1]["mean_score"] == 0.875 and got[1]["std_score"] == pytest.approx(math.sqrt(0.75 * 0.125**2 + 0.25 * 0.375**2))
    assert got[2]["std_score"] == 0.0 and got[1]["rank_score"] == got[2]["rank_score"] == 1


def test_r2_is_not_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "y double, p double")
    assert metrics.regression_scores(df, "y", "p").first()["r2"] == pytest.approx(1 - 29 / 2)


def test_learning_curve_equals_refits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 3 * x + rng.normal(size=60) + 100
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    for size in (1000, 9):
        got = {r["k"]: r for r in tune.learning_curve(df, "id", "x", "y", 10, range_rows=size).collect()}
        assert sorted(got) == list(range(1, 51))
        for k in (2, 10, 50):
            a, b = np.polyfit(x[:k], y[:k], 1)
            miss = y[k:] - a * x[k:] - b
            assert got[k]["slope"] == pytest.approx(a) and got[k]["intercept"] == pytest.approx(b)
            assert got[k]["mse"] == pytest.approx((miss**2).mean())
            assert got[k]["r2"] == pytest.approx(1 - (miss**2).sum() / ((y[k:] - y[k:].mean()) ** 2).sum())
        assert got[1]["slope"] == 0.0


def test_gradient_matches_cost(spark):
    _, df = binary(spark, 200)
    df = df.withColumn("one", F.lit(1.0))
    theta = [0.2, -0.7]
    g = {r["position"]: r["gradient"] for r in models.logistic_gradient(df, ["one", "p"], "y", theta, 3.0).collect()}
    for i in range(2):
        up, down = list(theta), list(theta)
        up[i] += 1e-5
        down[i] -= 1e-5
        rise = [models.logistic_cost(df, ["one", "p"], "y", t, 3.0).first()[0] for t in (up, down)]
        assert g[i] == pytest.approx((rise[0] - rise[1]) / 2e-5, abs=1e-7)


def test_logistic_fit_has_no_gradient_left(spark):
    _, df = binary(spark, 300)
    df = models.with_features(df.withColumn("one", F.lit(1.0)), ["p"])
    m = models.logreg_l2(df, "y", 1.0)
    theta = [m.intercept, m.coefficients[0]]
    g = models.logistic_gradient(df, ["one", "p"], "y", theta, 1.0).collect()
    assert max(abs(r["gradient"]) for r in g) < 1e-5


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(5)
    radius = np.where(np.arange(400) % 2 == 0, 1.0, 3.0) + rng.normal(scale=0.1, size=400)
    turn = rng.uniform(0, 2 * np.pi, size=400)
    data = [(i, [float(r * np.cos(a)), float(r * np.sin(a))], i % 2) for i, (r, a) in enumerate(zip(radius, turn, strict=True))]
    return models.with_features(spark.createDataFrame(data, "id long, v array<double>, y int").repartition(4), "v").cache()


def accuracy(df, label="y"):
    return metrics.accuracy(df, label, "prediction").first()[0]


def test_kernel_svm_separates_rings(rings):
    assert accuracy(models.linear_svm(rings, "y", 10.0, max_iter=50).transform(rings)) < 0.75
    scored = models.rbf_svm(rings, "v", "y", 100.0, 0.5, 128, 60).transform(rings)
    assert accuracy(scored) > 0.97
    p = models.platt(scored, "decision", "y")
    assert p.filter("probability_of_0 < 0 or probability_of_0 > 1").count() == 0
    assert p.filter("y = 0").agg(F.avg("probability_of_0")).first()[0] > 0.9


def test_boosting_beats_its_base(rings):
    boosted = models.adaboost(rings, "y", 8, 1.0, 2)
    base = models.random_forest(rings, "y", 1, 1)
    assert accuracy(boosted.transform(rings)) > max(0.9, accuracy(base.transform(rings)))
    assert all(e < 0.5 for e in boosted.errors)


def test_boosting_reweights_as_defined(spark, rings):
    boosted = models.adaboost(rings, "y", 2, 1.0, 1)
    (first, alpha), (second, _) = boosted.rounds
    scored = second.transform(first.transform(rings).select("features", "y", F.col("prediction").alias("p1")))
    w = F.when(F.col("p1") != F.col("y"), F.lit(math.exp(alpha))).otherwise(F.lit(1.0))
    error = scored.agg(F.sum(w * (F.col("prediction") != F.col("y")).cast("double")) / F.sum(w)).first()[0]
    assert boosted.errors[1] == pytest.approx(error)


def test_boosted_probabilities_sum_to_one(rings):
    scored = models.gradient_boost_clf(rings, "y", 5, 0.3, 3).transform(rings)
    assert scored.filter("abs(aggregate(probability, 0D, (s, v) -> s + v) - 1) > 1e-9").count() == 0
    assert accuracy(scored) > 0.9


def test_kmeans_and_majority(spark):
    df = spark.createDataFrame([(i, float(i % 2 * 10 + i / 1000), i % 2) for i in range(60)], "id long, x double, y int")
    data = models.with_features(df, ["x"])
    scored = models.kmeans(data, 2, 3, 20).transform(data)
    named = scored.join(models.majority_label(scored, "prediction", "y"), "prediction")
    assert named.filter("prediction_label <> y").count() == 0


def test_gaussian_wide_equals_narrow(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 30)) @ rng.normal(size=(30, 30))
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(30)))
    fit = anomaly.fit_gaussian(df, df.columns)
    mean, cov = x.mean(axis=0), np.cov(x, rowvar=False)
    d = x - mean
    want = -0.5 * (30 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
    got = [r[0] for r in df.select(fit.log_density()).collect()]
    assert np.allclose(got, want)
    few = anomaly.fit_gaussian(df, ["c0", "c1", "c2"])
    narrow = [r[0] for r in df.select(few.log_density()).collect()]
    wide = [r[0] for r in df.select(few._wide(np.linalg.inv(few.cov), 3 * anomaly.LOG_2PI + np.linalg.slogdet(few.cov)[1])).collect()]
    assert np.allclose(narrow, wide)


def planted(spark, n=1500):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(n, 3)), rng.normal(loc=9, scale=0.5, size=(15, 3))])
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def test_isolation_forest_finds_planted_rows(spark):
    df = planted(spark)
    forest = anomaly.isolation_forest(df.repartition(5), "id", "v", 40)
    scored = anomaly.flag_share(df.select("id", forest.score("v").alias("s")), "s", 0.02)
    assert scored.filter("is_outlier = 1 and id >= 1500").count() >= 14
    assert 30 <= scored.agg(F.sum("is_outlier")).first()[0] <= 31
    other = anomaly.isolation_forest(df.repartition(2), "id", "v", 40)
    assert np.array_equal(forest.cut, other.cut)


def test_one_class_share_is_nu(spark):
    df = planted(spark, 600)
    got = anomaly.one_class_boundary(df, "v", 0.2, 0.3, 64, 5).transform(df, "v")
    assert abs(got.agg(F.avg("is_outlier")).first()[0] - 0.2) < 0.01
    assert got.filter("id >= 600 and is_outlier = 1").count() == 15


def test_reconstruction_error_flags_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 8))
    x[:3] += rng.normal(scale=3, size=(3, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    top = anomaly.reconstruction_error(df, "v", 2).orderBy(F.desc("reconstruction_error")).limit(3).collect()
    assert {r["id"] for r in top} == {0, 1, 2}


def test_grid_search_table(spark, rings):
    folded = rows.stratified_folds(rings, "id", "y", 3)
    configs = [{"depth": 1}, {"depth": 4}, {"depth": 4}]
    got = tune.grid_search(folded, "fold", 3, "y", configs, lambda d, c: models.random_forest(d, "y", 3, c["depth"])).orderBy("config_id").collect()
    assert [r["rank_test_score"] for r in got] == [3, 1, 1]
    r = got[1]
    assert r["param_depth"] == "4" and r["mean_fit_time"] > 0 and r["split0_train_score"] >= 0.5 and "std_train_score" in r
    splits = [r[f"split{i}_test_score"] for i in range(3)]
    assert r["mean_test_score"] == pytest.approx(np.mean(splits)) and r["std_test_score"] == pytest.approx(np.std(splits))


def test_out_of_fold_model_covers_every_row_once(spark, rings):
    folded = rows.stratified_folds(rings, "id", "y", 2)
    got = tune.out_of_fold_model(folded, "id", "fold", 2, lambda d: models.random_forest(d, "y", 3, 3))
    assert sorted(r["id"] for r in got.select("id").collect()) == list(range(400))


def test_augmentation(spark):
    df = spark.createDataFrame([(i, [float((i * 7 + j) % 13) for j in range(64)]) for i in range(20)], "id long, px array<double>")
    same = {r["id"]: r["px"] for r in images.augment(df, "id", "px", 8, 0.0, 0.0, 0.0).collect()}
    assert all(np.allclose(same[r["id"]], r["px"]) for r in df.collect())
    a = {r["id"]: r["px"] for r in images.augment(df.repartition(1), "id", "px", 8).collect()}
    b = {r["id"]: r["px"] for r in images.augment(df.repartition(5), "id", "px", 8).collect()}
    assert a == b and a != same
    assert all(0 <= min(v) and max(v) <= 12 and len(v) == 64 for v in a.values())
    turned = images._warp(np.arange(9.0)[None], 3, np.array([90.0]), *[np.zeros(1)] * 3)
    assert np.allclose(turned[0], [6, 3, 0, 7, 4, 1, 8, 5, 2])


def test_csv_round_trips(spark):
    texts = ["a,b", None, 'q"x', "", " outer ", "two\nlines", "\r\n", "\\N", "\\n", "\\", "\\s\\", '"', "\t", "null", "é,\U0001d4b3\n\"\""]
    df = spark.createDataFrame([(i, t, float(i) if i else float("nan")) for i, t in enumerate(texts)], "id long, s string, x double")
    path = fresh_path(spark, "t")
    io.write_csv(df, path)
    io.write_csv(df, path, append=True)
    got = sorted((r.id, r.s, r.x) for r in io.read_csv(spark, path, df.schema, exact=True).filter("id > 0").collect())
    assert got == sorted([(i, t, float(i)) for i, t in enumerate(texts) if i] * 2)
    assert io.read_csv(spark, path, df.schema, exact=True).filter("x is null").count() == 2
    assert io.read_csv(spark, path, exact=True).dtypes == [("id", "int"), ("s", "string"), ("x", "double")]
    with pytest.raises(Exception, match="exists"):
        io.write_csv(df, path)


def test_csv_of_others(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,name\n1,"two\nlines"\n2,\n3,"say ""x"""\n')
    rows = io.read_csv(spark, str(tmp_path / "f.csv"), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, None), (3, 'say "x"')]


def test_release(spark):
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    before = spark.sparkContext.getCheckpointDir()
    assert release(spark) >= 1 and release(spark) == 0
    assert spark.sparkContext.getCheckpointDir() == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_attach_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, k string")
    side = spark.createDataFrame([("a", 1.0)], "k string, m double")
    small = sorted(map(str, attach(df, side, ["k"]).collect()))
    monkeypatch.setattr("tabflow.session.LOOKUP_ROWS", 0)
    assert sorted(map(str, attach(df, side, ["k"]).collect())) == small
    assert work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_probability_vector_shape(rings):
    m = models.mlp(rings, "y", [2, 4, 2], max_iter=10)
    assert m.transform(rings).select(F.size(vector_to_array("probability"))).distinct().first()[0] == 2


def test_fold_sweep_means_and_ranks(spark):
    df = spark.range(9).select("id", (F.col("id") % 3).cast("int").alias("fold"))
    table = {"a": [0.5, 0.7, None], "b": [0.4, 0.4, 0.4], "c": [0.1, 0.2, 0.0]}
    seen = []

    def run(train, test, c):
        folds = sorted(r.fold for r in test.select("fold").distinct().collect())
        seen.append((train.count(), test.count()))
        return table[c["name"]][folds[0]]

    rows = tune.fold_sweep(df, "fold", 3, [{"name": n} for n in "abc"], run, parallelism=1).orderBy("config_id").collect()
    assert [(round(r.mean_score, 12), r["rank"]) for r in rows] == [(0.4, 1), (0.4, 1), (0.1, 3)]
    assert set(seen) == {(6, 3)}


def test_sweep_and_threshold_agree_on_nan(spark):
    data = [(1, 0.1), (1, float("nan")), (0, 0.9), (0, 0.8), (1, 0.2), (None, 0.3), (1, None)]
    df = spark.createDataFrame(data, "y int, p double")
    best = metrics.threshold_sweep(df, "y", "p", 10).first()
    assert (best.tp, best.fn, best.fp, best.tn) == (2, 1, 0, 2)
    again = metrics.apply_threshold(df.filter("y is not null and p is not null"), "y", "p", best.epsilon).first()
    assert (again.tp, again.fn, again.fp, again.tn, again.f1) == (best.tp, best.fn, best.fp, best.tn, best.f1)
    assert metrics.threshold_sweep(df.filter("isnan(p)"), "y", "p").count() == 0


def test_kmeans_starts_share_scans(spark):
    """Every start ends where a plain loop over the same rows ends, and more starts need no more scans than the slowest one."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.6, size=(60, 3)) for c in (0.0, 2.0, 5.0)]).round(3)
    known = models.with_features(spark.createDataFrame([(list(map(float, v)),) for v in x], "v array<double>"), "v")
    data = known.unionByName(spark.createDataFrame([(None, None)], known.schema))
    model = models.kmeans(data, 3, 4, 100, tol=1e-9)
    ordered = known.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").collect()
    first = np.array([r.v for r in ordered])
    costs, steps = [], []
    for i in range(4):
        c, n = models._spread_start(first, 3, models.SEED + i), 0
        while True:
            near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(3)])
            n += 1
            if np.abs(new - c).max() <= 1e-12:
                break
            c = new
        costs.append(((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum())
        steps.append(n)
    assert np.allclose(model.costs, costs) and model.cost == pytest.approx(min(costs)) and model.scans <= max(steps) + 2
    got = model.transform(data).collect()
    assert [r.prediction for r in got if r.v is None] == [None]
    assert all(r.prediction == ((np.array(r.v) - model.centres) ** 2).sum(axis=1).argmin() for r in got if r.v is not None)
    with pytest.raises(ValueError):
        models.kmeans(data.limit(0))


def test_kmeans_scans_read_written_rows(spark, monkeypatch):
    plans = []

    def seen(rows, centres, *more, own=models._step_sums):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return own(rows, centres, *more)

    monkeypatch.setattr(models, "_step_sums", seen)
    df = models.with_features(spark.range(60, numPartitions=1).selectExpr("array(cast(id % 2 * 50 + id as double), 1D) as v"), "v")
    assert models.kmeans(df, 2, 3).clusterCenters()[0].shape == (2,)
    assert plans and not any("Exchange" in p for p in plans)

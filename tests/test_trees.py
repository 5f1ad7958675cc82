import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.operators import trees as T
from tabflow.operators.models import with_features


def table(spark, x, y, parts=3, extra=None):
    rows = [(i, [float(c) for c in v], None if t is None else float(t), int(extra[i]) if extra is not None else 0) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return with_features(spark.createDataFrame(rows, "id long, v array<double>, y double, fold int").repartition(parts), "v")


def spiral(n=400, features=5, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features)).astype(np.float32)
    y = (np.argmax(np.stack([x[:, 0], x[:, 1], 0.5 + 0 * x[:, 0]]), axis=0)).astype(int)
    return x, y


def one_tree(x, y, number, subset, depth, classes, seed=T.SEED):
    """A tree grown row by row with the same draws: a function from a row to class counts."""

    def grow(at, key, level):
        counts = np.bincount(y[at], minlength=classes)
        if level == depth or (counts > 0).sum() < 2:
            return counts
        low, high = x[at].min(axis=0), x[at].max(axis=0)
        order = [f for f in np.argsort(T.draws(np.array([key], np.uint64), x.shape[1], 1)[0], kind="stable") if high[f] > low[f]][:subset]
        u = T.draws(np.array([key], np.uint64), x.shape[1], 2)[0]
        best = (-1.0, None, None)
        for f in sorted(order):
            cut = np.float32(float(low[f]) + u[f] * (float(high[f]) - float(low[f])))
            cut = low[f] if cut >= high[f] else cut
            right = x[at, f] > cut
            score = sum((np.bincount(y[at[s]], minlength=classes).astype(float) ** 2).sum() / s.sum() for s in (~right, right))
            if score > best[0]:
                best = (score, f, cut)
        if best[1] is None:
            return counts
        _, f, cut = best
        right = x[at, f] > cut
        sides = [grow(at[s], T.child_keys(np.array([key], np.uint64), i)[0], level + 1) for i, s in enumerate((~right, right))]
        return (f, cut, *sides)

    node = grow(np.arange(len(x)), T._mixed(np.uint64(number) + T._mixed(np.uint64(seed)))[()], 0)

    def counts(row):
        here = node
        while isinstance(here, tuple):
            here = here[3] if row[here[0]] > here[1] else here[2]
        return here

    return counts


@pytest.mark.parametrize(("subset", "scan", "answer"), [("all", T.SCAN_NUMBERS, T.ANSWER_BYTES), (2, 400, T.ANSWER_BYTES), (3, T.SCAN_NUMBERS, 0)])
def test_extra_trees_equal_reference(spark, monkeypatch, subset, scan, answer):
    monkeypatch.setattr(T, "ANSWER_BYTES", answer)
    x, y = spiral()
    blocks = T.packed_rows(table(spark, x, y), "features", ["y"])
    size = T.subset_size(subset, 5)
    forest = T.grow_extra_trees(blocks, [T.Plan(i, size, 6) for i in range(8)], 3, 5, scan_numbers=scan)
    for t in range(8):
        want = one_tree(x, y, t, size, 6, 3)
        got = forest.value[forest.leaves(x, t, 6)]
        assert np.array_equal(got, np.array([want(r) for r in x]))


def test_extra_trees_layout_and_accuracy(spark):
    x, y = spiral(900)
    train, test = table(spark, x[:600], y[:600], 1), table(spark, x[600:], y[600:], 2)
    models = [T.extra_trees(d, "y", 60, "sqrt", 10) for d in (train, train.repartition(7))]
    shares = [sorted((r.id, tuple(r.probability)) for r in m.transform(test).collect()) for m in models]
    assert shares[0] == shares[1]
    assert models[0].transform(test).filter("prediction = y").count() > 0.9 * 300
    # Cuts lie anywhere between values, not on a few borders.
    inner = models[0].trees.left >= 0
    assert len(np.unique(models[0].trees.cut[inner])) > 0.95 * inner.sum()


def test_extra_trees_edges(spark):
    x = np.array([[1.0, np.nan], [1.0, np.nan], [2.0, np.nan], [2.0, 5.0], [2.0, 7.0]])
    y = [0, 0, 1, 2, 2]
    df = table(spark, x, y).unionByName(table(spark, [[9.0, 9.0]], [None])).unionByName(spark.createDataFrame([(7, None, 1.0, 0)], "id long, v array<double>, y double, fold int").withColumn("features", F.lit(None).cast(df_type(spark))))
    model = T.extra_trees(df, "y", 30, "all", 4)
    scored = {r.id: r for r in model.transform(df).select("id", "probability", "prediction").collect()}
    assert scored[7].probability is None and scored[7].prediction is None
    assert [scored[i].prediction for i in (1, 2, 3, 4)] == [0, 1, 2, 2]
    flat = T.extra_trees(table(spark, [[1.0]] * 4, [0, 0, 0, 1]), "y", 3, "all", 4)
    assert {tuple(r.probability) for r in flat.transform(table(spark, [[1.0]], [0])).collect()} == {(0.75, 0.25)}
    with pytest.raises(ValueError, match="no row"):
        T.extra_trees(df.limit(0), "y", 3)


def df_type(spark):
    from pyspark.ml.linalg import VectorUDT

    return VectorUDT()


def test_bootstrap_draws_about_once(spark):
    n = T._poisson(5, 20_000, 3, T.SEED)
    assert abs(n.mean() - 1) < 0.03 and abs((n == 0).mean() - np.exp(-1)) < 0.02
    x, y = spiral()
    model = T.extra_trees(table(spark, x, y), "y", 40, "sqrt", 8, bootstrap=True)
    assert model.transform(table(spark, x, y)).filter("prediction = y").count() > 0.9 * 400
    assert 0.8 * 400 < model.trees.value[model.trees.roots].sum(axis=1).mean() < 1.2 * 400


def test_folds_grow_together(spark):
    x, y = spiral(300)
    fold = np.arange(300) % 3
    df = table(spark, x, y, 4, fold)
    configs = [{"trees": 6, "subset": "sqrt", "depth": 3}, {"trees": 9, "subset": "all", "depth": 5}]
    got = {(r.config_id, r.fold): r for r in T.extra_trees_by_fold(df, "y", "fold", 3, configs).collect()}
    assert len(got) == 6
    for (c, f), r in got.items():
        own = T.extra_trees(df.filter(F.col("fold") != f), "y", configs[c]["trees"], configs[c]["subset"], configs[c]["depth"]).transform(df)
        hits = {k.test: k.n for k in own.filter("prediction = y").groupBy((F.col("fold") == f).alias("test")).agg(F.count("*").alias("n")).collect()}
        assert (r.test_rows, r.test_hits, r.train_rows, r.train_hits) == (100, hits[True], 200, hits[False])


def test_few_blocks_are_scored_by_all_cores(spark):
    x, y = spiral(300)
    df = table(spark, x, y, 1, np.arange(300) % 3)
    configs = [{"trees": 2, "subset": "all", "depth": 3}, {"trees": 3, "subset": "sqrt", "depth": 2}, {"trees": 1, "subset": "all", "depth": 1}]
    out = T.extra_trees_by_fold(df, "y", "fold", 3, configs)
    assert len(out.inputFiles()) >= spark.sparkContext.defaultParallelism / 2
    assert sorted((r.config_id, r.fold, r.test_rows, r.train_rows) for r in out.collect()) == [(c, f, 100, 200) for c in range(3) for f in range(3)]


def test_scans_read_mixed_nodes_and_answer_in_few_bytes(spark, monkeypatch):
    x, y = spiral(600)
    levels, answers = [], []

    def split(blocks, forest, plans, active, owner, keys, *a, own=T._split_nodes):
        levels.append((forest.value[active] > 0).sum(axis=1))
        return own(blocks, forest, plans, active, owner, keys, *a)

    def added(blocks, scan, answer, *a, own=T._added):
        if "right" in answer:
            answers.append((blocks.rdd.getNumPartitions(), sum(len(r.right) for r in blocks.mapInArrow(scan, answer).collect())))
        return own(blocks, scan, answer, *a)

    monkeypatch.setattr(T, "_split_nodes", split)
    monkeypatch.setattr(T, "_added", added)
    blocks = T.packed_rows(table(spark, x, y, 5), "features", ["y"])
    forest = T.grow_extra_trees(blocks, [T.Plan(i, 2, 6) for i in range(16)], 3, 5)
    assert len(levels) == 6 and all((n > 1).all() for n in levels[1:])
    # Two features of five were tried, and counts below 256 take a byte.
    inner = (forest.left >= 0).sum()
    assert sum(n for _, n in answers[2:]) <= 8 * inner * 3 * 2
    # Five blocks keep all cores busy.
    assert answers[0][0] >= spark.sparkContext.defaultParallelism
    every = (forest.value[forest.roots].sum(axis=1) == 600).all()
    assert every and all((forest.leaves(x, t, 6) == forest.paths(np.arange(16)).node[forest.paths(np.arange(16)).walked(x, t, 6)]).all() for t in range(16))


@pytest.mark.parametrize("size", [1, 3, 7, 40, 5000])
def test_sums_of_segments(size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(7000, 5)).astype(np.float32)
    name = np.sort(rng.integers(0, max(1, 7000 // size), 7000))
    order = rng.permutation(7000)
    here, count = np.unique(name, return_counts=True)
    cuts = rng.normal(size=(len(here), 5)).astype(np.float32)
    cuts[::3, 1] = np.nan
    edge = np.cumsum(count) - count
    low, high = T._ranges(x, order, count)
    assert np.array_equal(low, np.minimum.reduceat(x[order], edge)) and np.array_equal(high, np.maximum.reduceat(x[order], edge))
    want = np.add.reduceat((x[order] > np.repeat(cuts, count, axis=0)).astype(int), edge)
    below = np.concatenate([x, np.full((1, 5), -np.inf, np.float32)])
    assert np.array_equal(T._above(below, order, count, cuts, np.arange(len(here))), want)


def test_held_rows_are_bounded(spark, monkeypatch):
    x, y = spiral(800)
    df = table(spark, x, y, 9)
    plans = [T.Plan(i, 5, 5) for i in range(6)]
    want = T.grow_extra_trees(T.packed_rows(df, "features", ["y"]), plans, 3, 5)
    monkeypatch.setattr(T, "HELD_BYTES", 5000)
    monkeypatch.setattr(T, "UNIT_BYTES", 2500)
    blocks = T.packed_rows(df, "features", ["y"])
    got = T.grow_extra_trees(blocks, plans, 3, 5)
    assert np.array_equal(want.value, got.value) and np.array_equal(want.cut, got.cut)
    batch = blocks.withColumn("share", F.lit(0)).toArrow().to_batches()
    held = list(T._held(iter(batch), False))
    assert len(held) > 1 and sum(len(u.y) for _, units in held for u in units) == 800


def boosted_reference(x, y, classes, rounds, rate, depth, penalty, borders, base, least_weight=1.0):
    """Margins of exhaustive second-order boosting over the same bins."""
    bins = T._binned(x, borders)
    columns = len(base)
    margins = np.tile(base, (len(x), 1))
    for _ in range(rounds):
        g, h = T.gradients(margins, y, classes)
        for k in range(columns):

            def grow(at, level, k=k, g=g, h=h):
                own = (g[at, k].sum(), h[at, k].sum())
                best = (1e-9, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for b in range(borders.shape[1]):
                            left = bins[at, f] <= b
                            sums = [(g[at[s], k].sum(), h[at[s], k].sum()) for s in (left, ~left)]
                            if min(s[1] for s in sums) >= least_weight:
                                gain = sum(s[0] ** 2 / (s[1] + penalty) for s in sums) - own[0] ** 2 / (own[1] + penalty)
                                if round(gain, 9) > best[0]:
                                    best = (round(gain, 9), (f, b))
                if best[1] is None:
                    margins[at, k] += -rate * own[0] / (own[1] + penalty)
                    return
                f, b = best[1]
                left = bins[at, f] <= b
                grow(at[left], level + 1)
                grow(at[~left], level + 1)

            grow(np.arange(len(x)), 0)
    return margins


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_equals_reference(spark, classes):
    x, y = spiral(200, 3)
    y = x[:, 0] * x[:, 1] + 1 if classes == 0 else np.minimum(y, classes - 1)
    df = table(spark, x, y, 3)
    model = T.boost(df, "y", classes, 7, 0.3, 3, 0.5, bins=16, write_rounds=3)
    want = boosted_reference(x, np.asarray(y, float), classes, 7, 0.3, 3, 0.5, model.borders, model.base)
    assert np.allclose(model.margins(x), want, atol=1e-6)
    assert all(b <= a + 1e-12 for a, b in zip(model.losses[:-1], model.losses[1:], strict=True))
    scored = {r.id: r for r in model.transform(df).collect()}
    for i in range(0, 200, 17):
        if classes:
            assert np.allclose(scored[i].probability, T._probabilities(want[i : i + 1])[0], atol=1e-6)
        else:
            assert scored[i].prediction == pytest.approx(want[i, 0], abs=1e-6)


def test_boosting_layout_columns_and_nan(spark, monkeypatch):
    x, y = spiral(500)
    x[::7, 2] = np.nan
    df = table(spark, x, y, 1)
    kw = {"by_tree": 0.8, "by_level": 0.7, "by_node": 0.7, "bins": 20}
    a = T.boost(df, "y", 3, 8, 0.3, 3, **kw)
    monkeypatch.setattr(T, "ANSWER_BYTES", 0)
    b = T.boost(df.repartition(6), "y", 3, 8, 0.3, 3, **kw)
    assert np.array_equal(a.trees.value, b.trees.value) and np.array_equal(a.trees.feature, b.trees.feature)
    assert np.array_equal(T.drawn_columns(10, (0.5, 0.5, 1.0), (1, 2, 3), 5), T.drawn_columns(10, (0.5, 0.5, 1.0), (1, 2, 3), 5))
    assert T.drawn_columns(10, (0.5, 0.5, 1.0), (1, 2, 3), 5).sum() == 2
    assert a.transform(df).filter("prediction = y").count() > 0.9 * 500


def test_joint_loss_beats_one_against_rest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 4))
    score = np.stack([x[:, 0], x[:, 1], x[:, 2], x[:, 3]]) + rng.gumbel(size=(4, 1500)) * 0.3
    y = np.argmax(score, axis=0)
    train, test = table(spark, x[:1000], y[:1000]), table(spark, x[1000:], y[1000:])
    joint = T.boost(train, "y", 4, 20, 0.1, 3)
    own = np.column_stack([T._probabilities(T.boost(train.withColumn("one", (F.col("y") == k).cast("double")), "one", 2, 20, 0.1, 3).margins(x[1000:].astype(np.float32)))[:, 1] for k in range(4)])
    p = T._probabilities(joint.margins(x[1000:].astype(np.float32)))
    at = (np.arange(500), y[1000:])
    assert -np.log(p[at]).mean() < -np.log((own / own.sum(axis=1, keepdims=True))[at]).mean()
    assert joint.transform(test).filter("prediction = y").count() > 0.75 * 500


def test_forest_grid_table(spark):
    from tabflow.operators import tune

    x, y = spiral(240)
    df = table(spark, x, y, 4, np.arange(240) % 4)
    configs = [{"trees": 3, "subset": "all", "depth": 1}, {"trees": 12, "subset": "all", "depth": 6}]
    rows = tune.forest_grid(df, "fold", 4, "y", configs).orderBy("config_id").collect()
    assert [r.rank_test_score for r in rows] == [2, 1]
    for r in rows:
        scores = [r[f"split{i}_test_score"] for i in range(4)]
        assert r.mean_test_score == pytest.approx(np.mean(scores)) and r.std_test_score == pytest.approx(np.std(scores)) and r.mean_train_score >= r.mean_test_score - 0.1
    assert rows[1].param_trees == "12" and rows[1].mean_fit_time > rows[0].mean_fit_time


def test_falling(spark):
    from tabflow.plans.learners import falling

    rows = [(float(i), -float(i // 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert falling(df, "x", "y", 7) and falling(df.limit(0), "x", "y") and falling(df.filter("x = 3"), "x", "y")
    assert not falling(spark.createDataFrame([*rows, (50.5, 0.0)], "x double, y double"), "x", "y", 7)
    assert not falling(spark.createDataFrame([*rows, (98.9, 0.0)], "x double, y double"), "x", "y", 50)


@pytest.mark.parametrize("classes", [0, 3])
def test_boosting_scans_sums_of_equal_bins(spark, monkeypatch, classes):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    y = x[:, 0] * x[:, 1] if classes == 0 else rng.integers(0, 3, 3000).astype(float) * (x[:, 0] > 0)
    df = table(spark, x, y, 3)
    read = []
    monkeypatch.setattr(T, "_boost_level", lambda rows, *a, own=T._boost_level: read.append(rows) or own(rows, *a))
    few = T.boost(df, "y", classes, 3, 0.3, 2, bins=8)
    rows = sum(len(r.n) // 8 for r in read[0].select("n").collect())
    assert rows <= 9 * 9 * max(1, classes) and sum(np.frombuffer(r.n, "<i8").sum() for r in read[0].select("n").collect()) == 3000
    monkeypatch.setattr(T, "MOST_CELLS", 0)
    every = T.boost(df, "y", classes, 3, 0.3, 2, bins=8)
    assert sum(len(r.n) // 8 for r in read[-1].select("n").collect()) == 3000
    assert np.array_equal(few.trees.value, every.trees.value) and np.array_equal(few.trees.cut, every.trees.cut)
    assert np.allclose(few.losses, every.losses)


def test_whole_sums_are_exact():
    cell, values = np.array([0, 1, 0, 1]), np.array([(1 << 58) + 1, -(1 << 58) - 3, 2, 1])
    assert T._whole_sums(cell, values, 3).tolist() == [(1 << 58) + 3, -(1 << 58) - 2, 0]


def test_boosting_sums_drawn_columns_once_a_round(spark, monkeypatch):
    """Trees of few drawn columns take one scan for all levels and are those of a scan a level."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 4)).round(1)
    for classes, y in ((0, x[:, 0] * x[:, 1]), (3, (x[:, 0] > 0) + (x[:, 1] > x[:, 2]) * 1.0)):
        df = table(spark, x, y, 3)
        kw = {"by_tree": 0.5, "by_level": 0.5, "by_node": 0.5, "bins": 12}
        scans = []
        with monkeypatch.context() as m:
            m.setattr(T, "_sum_boxes", lambda *a, own=T._sum_boxes: scans.append(1) or own(*a))
            once = T.boost(df, "y", classes, 9, 0.3, 4, **kw)
        assert len(scans) == 9
        with monkeypatch.context() as m:
            m.setattr(T, "ANSWER_BYTES", 0)
            m.setattr(T, "MOST_CELLS", 0)
            every = T.boost(df, "y", classes, 9, 0.3, 4, write_rounds=4, **kw)
            want = every.transform(df).select("id", "prediction").collect()
        for name in ("roots", "feature", "cut", "left", "value"):
            assert np.array_equal(getattr(once.trees, name), getattr(every.trees, name))
        assert np.allclose(once.losses, every.losses) and len(once.trees.roots) == 9 * max(1, classes)
        assert sorted(map(tuple, once.transform(df).select("id", "prediction").collect())) == sorted(map(tuple, want))




def test_boosted_query_keeps_the_operators_defaults(spark, monkeypatch):
    from types import SimpleNamespace

    from tabflow.operators import models
    from tabflow.plans import learners

    def boost(df, label, classes, rounds, rate, depth, penalty, least_weight, *shares, **kw):
        assert (rounds, rate, depth, penalty, shares) == (2000, 0.01, 6, 0.01, (0.5, 0.5, 0.5))
        raise StopIteration

    monkeypatch.setattr(models.forests, "boost", boost)
    rows = [(i, float(i % 50), 1.0, i % 11 / 100, i % 9 / 100, 0) for i in range(60)]
    sensors = spark.createDataFrame(rows, "row_key long, s1 double, s2 double, s3 double, s4 double, att_flag int")
    with pytest.raises(StopIteration):
        learners.gradient_boost_reg(SimpleNamespace(sensor_row=sensors, spark=spark))

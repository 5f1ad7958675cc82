"""Series statistics, the lag kernel and neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.operators import neighbors, rows, series
from tabflow.plans.pipelines import light_curve_features


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    data = []
    for i in range(3000):
        star = 1 if rng.random() < 0.35 else rng.randrange(2, 40)
        data.append((i, star, rng.randrange(3), rng.uniform(0, 900), rng.gauss(0, 10), rng.uniform(0.5, 2), int(rng.random() < 0.3)))
    return spark.createDataFrame(data, "id long, object_id long, passband int, mjd double, flux double, flux_err double, detected int").repartition(6).cache()


def test_band_stats_do_not_depend_on_the_hot_way(points):
    plain = series.band_stats_long(points, "object_id", "passband", "flux").orderBy("object_id", "passband").toPandas()
    hot = series.band_stats_long(points, "object_id", "passband", "flux", hot_rows=25).orderBy("object_id", "passband").toPandas()
    assert np.allclose(plain[series.STATS].astype(float), hot[series.STATS].astype(float), equal_nan=True)


def test_missing_band_and_single_point(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 0, 7.0), (2, 1, 3.0)], "o long, b int, f double")
    long = series.band_stats_long(df, "o", "b", "f")
    got = {r["o"]: r for r in series.widen(long, "o", "b", [0, 1], series.STATS, series.BAND_LETTERS).collect()}
    assert got[1]["mn_u"] == 6.0 and got[1]["mn_g"] is None
    assert got[2]["md_g"] == 3.0 and got[2]["st_g"] is None and got[2]["mx_u"] is None


def test_span_without_detection_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 4.0, 1), (1, 9.0, 0), (2, 3.0, 0)], "o long, t double, d int")
    assert {r[0]: r[1] for r in series.detected_span(df, "o", "t", "d").collect()} == {1: 3.0, 2: None}


def test_light_curve_refuses_unknown_object(points):
    got = series.light_curve(points, "object_id", 1, "mjd", "flux", "passband", series.BAND_LETTERS)
    assert {r["passband"] for r in got.collect()} == {"u", "g", "r"}
    with pytest.raises(ValueError):
        series.light_curve(points, "object_id", 999, "mjd", "flux", "passband", series.BAND_LETTERS)


def test_feature_table(spark, points):
    meta = points.select("object_id").distinct().select(
        "object_id", (F.col("object_id") % 2).cast("int").alias("ddf"), F.lit(2.0).alias("hostgal_photoz"),
        (F.col("object_id") % 4).cast("double").alias("hostgal_photoz_err"), F.rand(1).alias("mwebv"), F.lit(0.1).alias("decl"), (F.col("object_id") % 3).alias("target"),
    )
    old = light_curve_features(points, meta, [0, 1, 2], "old", series.BAND_LETTERS)
    new = light_curve_features(points, meta, [0, 1, 2], "new", series.BAND_LETTERS)
    assert set(new.columns) - set(old.columns) == {"mjd_diff", *(f"{s}_{b}" for s in ("rtsq", "flrt") for b in "ugr")}
    assert "decl" not in old.columns and "mwebv" in old.columns
    s = new.agg(F.avg("mn_u"), F.stddev_pop("mn_u"), F.count("*")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9 and s[2] == meta.count()
    with pytest.raises(ValueError):
        light_curve_features(points, meta, [0], "other")


def test_window_features_of_known_window(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([2.0, 5.0, 5.0, 1.0, 7.0])] + [(2, 0, 4.0)], "w long, t int, x double")
    got = {r["w"]: r for r in series.window_features(df, ["w"], ["t"], "x").collect()}
    a, b = got[1], got[2]
    assert (a["mean"], a["median"], a["abs_energy"], a["absolute_sum_of_changes"], a["mean_change"]) == (4.0, 5.0, 104.0, 13.0, 1.25)
    assert (a["count_above_mean"], a["count_below_mean"], a["first_location_of_maximum"], a["last_location_of_minimum"]) == (3, 2, 0.8, 0.8)
    x = np.array([2.0, 5, 5, 1, 7]) - 4
    assert a["autocorrelation_lag_1"] == pytest.approx((x[:-1] * x[1:]).sum() / (4 * x.var()))
    assert a["linear_trend_slope"] == pytest.approx(np.polyfit(range(5), x + 4, 1)[0])
    assert b["mean_change"] is None and b["linear_trend_slope"] is None and b["variance"] == 0.0


def brute_kernel(events, tau):
    out = {}
    for s, kind, t in events:
        out.setdefault(s, ([], []))[0 if kind == "in" else 1].append(t)
    return {
        s: sum(math.exp(-(i - o) / tau) if i > o else -math.exp((i - o) / tau) for i in ins for o in outs) for s, (ins, outs) in out.items()
    }


def test_lag_kernel(spark):
    rng = random.Random(8)
    # Equal times, a series over many blocks, one-sided series and a hot one.
    events = [(1, rng.choice(["in", "out"]), float(rng.randrange(60))) for _ in range(400)]
    events += [(2, rng.choice(["in", "out"]), rng.uniform(0, 20000)) for _ in range(300)]
    events += [(3, "in", 5.0), (4, "in", 1.0), (4, "out", 1.0), (5, "out", 490.0), (5, "in", 505.0), (6, "out", -3.0), (6, "in", -1.5)]
    df = spark.createDataFrame(events, "s long, kind string, t double").repartition(5)
    want = brute_kernel(events, 10.0)
    for size in (100_000, 40):
        got = {r["s"]: r["weight_change"] for r in series.pair_lag_kernel(df, "s", "kind", "t", "in", "out", range_rows=size).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[s], v, rel_tol=1e-9, abs_tol=1e-9) for s, v in want.items())
    assert got[4] == -1.0


def test_step_blocks(spark):
    got = series.step_blocks(spark.range(20), ["id"], "id", 6, blocks=2).collect()
    assert sorted((r["block"], r["time"]) for r in got) == [(i // 6, i) for i in range(12)]


def vectors(spark, n=400, p=4, seed=3):
    rng = np.random.default_rng(seed)
    # A third of the rows in one tight clump, some exact copies.
    x = np.vstack([rng.normal(scale=0.05, size=(n // 3, p)), rng.normal(scale=5, size=(n - n // 3 - 5, p)), np.ones((5, p))])
    df = spark.createDataFrame([(i, [float(v) for v in r], int(r[0] > 0)) for i, r in enumerate(x)], "id long, v array<double>, label int").repartition(5)
    return x, df


def brute_neighbors(x, q, k, metric, skip_self):
    out = {}
    for i in q:
        d = np.abs(x - x[i]).sum(axis=1) if metric == "manhattan" else np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if not (skip_self and j == i)]
        out[i] = [int(j) for j in order[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("skip_self", [True, False])
def test_neighbors_by_both_ways(spark, metric, skip_self):
    x, df = vectors(spark)
    want = brute_neighbors(x, range(len(x)), 7, metric, skip_self)
    for got in (
        neighbors.knn(df, df, "id", "v", 7, metric, skip_self),
        neighbors.knn(df, df, "id", "v", 7, metric, skip_self, sent_rows=10),
        neighbors.knn_by_cells(df, df, "id", "v", 7, metric, skip_self, n_pivots=12, piece_rows=30),
    ):
        found = {}
        for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
            found.setdefault(r["query_id"], []).append(r["neighbor_id"])
        assert found == want


def test_slack_bounds_the_distance(spark):
    x, df = vectors(spark)
    exact = {(r["query_id"], r["rank"]): r["distance"] for r in neighbors.knn(df, df, "id", "v", 5, exclude_self=True).collect()}
    loose = neighbors.knn_by_cells(df, df, "id", "v", 5, exclude_self=True, slack=0.5, n_pivots=20).collect()
    assert len(loose) == len(exact)
    assert all(r["distance"] <= 1.5 * exact[(r["query_id"], r["rank"])] + 1e-9 for r in loose)


def test_votes(spark):
    near = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 2.0, 2), (1, 12, 2.0, 3), (2, 10, 0.0, 1), (2, 11, 0.1, 2), (2, 12, 0.1, 3)], "query_id long, neighbor_id long, distance double, rank int")
    labels = spark.createDataFrame([(10, 5), (11, 3), (12, 3)], "id long, y int")

    def votes(w):
        return {r["query_id"]: r["prediction"] for r in neighbors.classify(near, labels, "id", "y", w).collect()}

    assert votes("uniform") == {1: 3, 2: 3}
    assert votes("distance") == {1: 3, 2: 5}


def test_fewer_rows_than_k(spark):
    _, df = vectors(spark, n=9)
    assert neighbors.knn(df, df, "id", "v", 50).count() == 81
    assert neighbors.knn_by_cells(df, df, "id", "v", 50, n_pivots=3).count() == 81


def test_layout_does_not_matter(points):
    a, b = (rows.tumbling(points.repartition(n), ["mjd", "id"], 5, ["object_id"], range_rows=90).select("id", "window_id") for n in (1, 7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_hashed_neighbors(spark):
    """Clustered vectors are found in buckets, crowded ones in pieces; vectors without structure are searched exactly."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 24)) * 3
    x = centres[rng.integers(30, size=900)] + rng.normal(size=(900, 24)) * 0.5
    x[:5] = 40 * rng.normal(size=(5, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    planes = neighbors.fit_hash(df, "id", "v", 6)
    assert planes is not None
    want = {(r.query_id, r.neighbor_id) for r in neighbors.knn(df, df, "id", "v", 6, exclude_self=True).collect()}
    for size in (4000, 20):
        got = {(r.query_id, r.neighbor_id) for r in neighbors.knn_by_hash(df, df, "id", "v", 6, planes, True, piece_rows=size).collect()}
        assert len(got & want) >= 0.9 * len(want)
    rows = neighbors.knn_approx(df, df, "id", "v", 6, exclude_self=True).collect()
    assert len(rows) == 900 * 6 and {r["rank"] for r in rows} == set(range(1, 7))
    noise = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))], "id long, v array<double>")
    assert neighbors.fit_hash(noise, "id", "v", 5) is None
    assert neighbors.knn_approx(noise, noise, "id", "v", 5).count() == 1500
    assert neighbors.fit_hash(noise.limit(0), "id", "v", 5) is None


def test_neighbors_hold_few_numbers_at_once(spark, monkeypatch):
    """Whatever the number of cells, tables and rows, arrays of distances and frames of copied vectors stay small; results don't change."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 20))
    x[600:] = x[:100]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(neighbors, "BLOCK_VALUES", 2000)
    block, largest = neighbors._block, []

    def watched(q, rows, *args):
        largest.append(len(q) * len(rows))
        return block(q, rows, *args)

    monkeypatch.setattr(neighbors, "_block", watched)
    found = neighbors._nearest(x, x, np.arange(700), np.arange(700), 5, "euclidean", True)
    assert len(largest) > 1 and max(largest) <= 2000
    want = brute_neighbors(x, range(len(x)), 5, "euclidean", True)
    assert found.groupby("query_id")["neighbor_id"].apply(list).to_dict() == want
    assert max(s.stop - s.start for s in neighbors._slices(5000, 64)) * 64 <= 2000


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbors_by_blocks(spark, monkeypatch, metric):
    """Vectors that cells don't tell apart are not copied: blocks of queries pass units of rows, and only the last pass stays on disk."""
    from tabflow import session

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    x[850:] = x[:50]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    want = brute_neighbors(x, range(0, 900, 2), 7, metric, True)
    monkeypatch.setattr(neighbors, "UNIT_BYTES", 40_000)
    monkeypatch.setattr(neighbors, "PACK_BYTES", 8_000)
    monkeypatch.setattr(neighbors, "MOST_COPIES", 1)
    chosen = []
    monkeypatch.setattr(neighbors, "knn_by_blocks", lambda *a, own=neighbors.knn_by_blocks: chosen.append(1) or own(*a))
    session.release(spark)
    found = {}
    for r in sorted(neighbors.knn(df, df.filter("id % 2 = 0"), "id", "v", 7, metric, True, sent_rows=10).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.neighbor_id)
    assert found == want and chosen == [1]
    assert session.release(spark) == 1


def test_neighbors_by_blocks_of_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 2.0]), (None, [0.0, 3.0]), (4, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = neighbors.knn_by_blocks(df, df.filter("id = 4 or id is null"), "id", "v", 3, exclude_self=True).collect()
    want = {None: [(1, 1.0), (1, 2.0), (None, 0.0)], 4: [(None, 29**0.5), (1, 34**0.5), (1, 41**0.5)]}
    for k, near in want.items():
        assert sorted(((r.neighbor_id, round(r.distance, 9)) for r in got if r.query_id == k), key=str) == sorted(((i, round(d, 9)) for i, d in near), key=str)
    assert neighbors.knn_by_blocks(df.limit(0), df, "id", "v", 3).count() == 0
    assert neighbors.knn_by_blocks(df, df, "id", "v", 50).count() == 16


def test_steps_of_a_fold_are_deleted(spark):
    from tabflow import session
    from tabflow.operators import tune

    session.release(spark)
    df = spark.range(30).selectExpr("id", "cast(id % 3 as int) as fold")
    table = tune.fold_sweep(df, "fold", 3, [{"a": 1}, {"a": 2}], lambda train, test, c: session.cut_lineage(train).count() / c["a"])
    assert [r.fold0 for r in table.orderBy("config_id").collect()] == [20.0, 10.0]
    assert session.release(spark) == 1

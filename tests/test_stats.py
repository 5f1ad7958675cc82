"""Quantiles, cleaning, encoding, scaling and table statistics on small known tables."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.functions import dates, hashing, maths, text
from tabflow.operators import clean, encode, quantiles, scale, stats


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_kth_smallest_by_narrowing(spark):
    rng = random.Random(5)
    values = [rng.choice([7.0, rng.random() * 100]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ordered = sorted(values)
    for rank in (0, 1, 200, 2500, 4999):
        assert quantiles.kth_smallest(df, "v", rank, small=50) == ordered[rank]


def test_quantiles_both_ways(spark):
    rng = random.Random(6)
    data = [(rng.random() * 10, float(rng.randrange(5))) for _ in range(3001)]
    df = spark.createDataFrame(data, "a double, b double")
    probs = [0.25, 0.5, 0.9]
    want = {c: np.quantile([d[i] for d in data], probs) for i, c in enumerate("ab")}
    for small in (1_000_000, 40):
        got = quantiles.exact_quantiles(df, ["a", "b"], probs, small)
        for c in "ab":
            assert np.allclose(got[c], want[c])


def test_median_of_hot_groups(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", rng.choice([3.0, rng.gauss(0, 5)])) for _ in range(4000)]
    data += [("even", 1.0), ("even", 4.0), ("none", None)]
    want = {}
    for k, v in data:
        if v is not None:
            want.setdefault(k, []).append(v)
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    for hot in (1_000_000, 60, 1):
        got = {r["k"]: r["median"] for r in quantiles.group_median(df, ["k"], "v", hot_rows=hot).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], statistics.median(v)) for k, v in want.items())


def test_text_parsers(spark):
    df = spark.createDataFrame([("$15 ", "1,800,000", "Braund, Mr. Owen"), ("x", None, "no comma"), ("$5,800", "12", "O'Hara, the Countess. of (A, B)")], "a string, b string, c string")
    got = df.select(
        text.parse_currency(F.col("a")), text.parse_thousands(F.col("b")), text.after_comma_word(F.col("c")), text.before_comma(F.col("c"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (15, 1800000, "Mr", "Braund"), (None, None, None, "no comma"), (5800, 12, "the Countess", "O'Hara"),
    ]


def test_dates(spark):
    c = F.lit("06/01/14 00")
    parts = dates.datetime_parts(c)
    assert [one(spark, parts[p]) for p in ("time", "day", "month")] == [0, 6, 1]
    assert one(spark, dates.datetime_parts(F.lit("bad"))["time"]) is None
    assert math.isclose(one(spark, dates.datetime_cyclic(c)["day_sine"]), math.sin(6))
    assert math.isclose(one(spark, dates.datetime_cyclic(c, scaled=True)["month_cosine"]), math.cos(2 * math.pi / 12))


def test_key_noise_is_normal_and_layout_free(spark):
    df = spark.range(20000)
    a = df.repartition(3).select("id", hashing.normal("id", 1).alias("x"))
    s = a.agg(F.avg("x"), F.stddev_pop("x"), F.skewness("x")).first()
    assert abs(s[0]) < 0.03 and abs(s[1] - 1) < 0.03 and abs(s[2]) < 0.1
    b = df.repartition(9).select("id", hashing.normal("id", 1).alias("y"))
    assert a.join(b, "id").filter("x <> y").count() == 0
    j = df.agg(F.min(hashing.integer_jitter("id", 157)), F.max(hashing.integer_jitter("id", 157))).first()
    assert tuple(j) == (-6, 5)


def test_conditional_assign_last_write_wins(spark):
    rules = [(F.lit(True), F.lit(1)), (F.lit(True), F.lit(2)), (F.lit(None).cast("boolean"), F.lit(3))]
    assert one(spark, clean.assign_where(F.lit(0), rules)) == 2


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert clean.nan_to_null(df).agg(F.avg("x"), F.count("x")).first()[:] == (1.0, 1)


def test_modes_tie_to_smallest(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 2), ("a", 3), (None, None)], "s string, n int")
    got = {r["column"]: (r["value"], r["n"]) for r in clean.modes(df, ["s", "n"]).collect()}
    assert got == {"s": ("a", 2), "n": ("2", 2)}
    assert {r["n"] for r in clean.impute_mode(df, ["s", "n"]).filter("s = 'a'").collect()} >= {2}


def test_impute_group_mean(spark):
    df = spark.createDataFrame([(1, "Mr", 20.0), (2, "Mr", 23.0), (3, "Mr", None), (4, "Dr", None), (5, "Rev", 40.5), (6, "Rev", None)], "id long, t string, age double")
    got = {r["id"]: r["age"] for r in clean.impute_group_mean(df, "id", "t", "age", ["Mr"]).collect()}
    assert got[4] is None and got[6] == 41.0 and 16 <= got[3] <= 27 and got[1] == 20.0


def test_impute_median_inf(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (inf,), (-inf,), (float("nan"),), (None,)], "x double")
    assert sorted(r.x for r in clean.impute_median_inf(df, ["x"]).collect()) == [1.0, 1.0, 2.0, 2.0, 2.0, 9.0, 9.0]


def test_low_cardinality_near_the_cut(spark):
    df = spark.range(5000).select(*[(F.col("id") % n).alias(f"c{n}") for n in (5, 99, 100, 101, 3000)])
    assert clean.drop_low_cardinality(df, df.columns).columns == ["c100", "c101", "c3000"]


def test_bins(spark):
    df = spark.createDataFrame([(None,), (1.0,), (10.0,), (11.0,), (50.0,)], "x double")
    edges = encode.equal_width_edges(df, "x", 5)
    assert edges == [10.0, 20.0, 30.0, 40.0]
    assert [r[0] for r in df.select(encode.bin_by_edges(F.col("x"), edges)).collect()] == [0, 0, 0, 1, 4]


def test_one_hot_rows_sum_to_one_and_guard(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string")
    got = encode.one_hot(df, ["s"])
    assert got.columns == ["s_a", "s_b"]
    assert sorted(r.s_a + r.s_b for r in got.collect()) == [0, 1, 1, 1]
    with pytest.raises(ValueError):
        encode.categories(spark.range(20).withColumn("k", F.col("id").cast("string")), "k", 10)


def test_label_codes_transfer(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "s string")
    test = spark.createDataFrame([("c",), ("z",), (None,)], "s string")
    codes = encode.label_codes(train, "s")
    assert [r["s_code"] for r in encode.label_encode(test, "s", codes=codes).orderBy(F.col("s").asc_nulls_last()).collect()] == [2, None, None]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (2.0, 5.0, "a"), (4.0, 5.0, "b"), (None, 5.0, "b")], "x double, k double, s string")
    got = scale.standardise(df, ["x", "k"]).agg(F.avg("x"), F.stddev_pop("x"), F.max("k"), F.min("k"), F.count("x")).first()
    assert abs(got[0]) < 1e-12 and abs(got[1] - 1) < 1e-12 and got[2] == got[3] == 0.0 and got[4] == 3
    by = scale.standardise_by(df, "s", ["x"]).filter("s = 'b'").orderBy(F.col("x").desc_nulls_last()).collect()
    assert [r.x for r in by] == [0.0, None]
    fit = scale.fit_standard(df, ["x"])
    assert fit.shift["x"] == pytest.approx(7 / 3)


def test_wide_scaler_equals_narrow(spark):
    df = spark.range(50).select(*[(F.col("id") * i + i).cast("double").alias(f"c{i}") for i in range(12)], F.lit(None).cast("double").alias("gap"))
    wide, narrow = scale.fit_standard(df, df.columns), scale.fit_standard(df, ["c0", "c7", "gap"])
    for c in ("c0", "c7"):
        assert wide.shift[c] == pytest.approx(narrow.shift[c]) and wide.spread[c] == pytest.approx(narrow.spread[c])
    assert wide.shift["gap"] is None and narrow.shift["gap"] is None
    assert wide.transform(df).agg(F.count("gap"), F.max("c0")).first()[:] == (0, 0.0)
    assert scale.fit_standard(df.filter("false"), df.columns).shift["c1"] is None


def test_scaler_runs_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, x double")
    df.write.parquet(str(tmp_path / "in"))
    fit = scale.fit_standard(df, ["x"])
    stream = fit.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("scaled").start()
    job.processAllAvailable()
    job.stop()
    assert abs(spark.table("scaled").agg(F.avg("x")).first()[0]) < 1e-12


def matrix(spark, n=300, p=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + rng.normal(size=p)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)
    return x, df


def test_covariance_both_ways(spark):
    x, df = matrix(spark, p=30)
    cols = [f"c{i}" for i in range(30)]
    wide = df.select(*[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    want = np.cov(x, rowvar=False)
    for names in (cols, cols[:5]):
        for r in stats.mean_cov(wide, names).collect():
            i, j = cols.index(r["col_i"]), cols.index(r["col_j"])
            assert r["cov"] == pytest.approx(want[i, j])
            assert r["mean_i"] == pytest.approx(x[:, i].mean())


def test_covariance_with_gaps_both_ways(spark, monkeypatch):
    """NULL, NaN, a constant, an empty and a nearly empty column: the wide way equals the narrow one."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 30)) + 1e3
    rows = [[None if rng.random() < 0.2 and j % 3 == 0 else float(v) for j, v in enumerate(line)] for line in x]
    for i, line in enumerate(rows):
        line[1], line[2], line[4] = 7.0, None, 5.0 if i == 3 else None
        if i in (5, 6):
            line[8] = float("nan")
        line[9] = None if i == 5 else line[9]
        line[10] = None if i in (5, 6) else line[10]
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4)
    found = {}
    for limit in (0, 10_000):
        monkeypatch.setattr(stats, "_PAIRS_IN_ONE_AGG", limit)
        found[limit] = {(r.col_i, r.col_j): (r.mean_i, r.mean_j, r["cov"]) for r in stats.mean_cov(df, cols).collect()}
    assert set(found[0]) == set(found[10_000])
    for k, narrow in found[10_000].items():
        for a, b in zip(found[0][k], narrow, strict=True):
            assert (a is None) == (b is None), (k, found[0][k], narrow)
            assert a is None or a == pytest.approx(b, nan_ok=True, abs=1e-9), (k, found[0][k], narrow)
    assert found[0]["c8", "c10"][2] == pytest.approx(found[0]["c8", "c10"][2]) and np.isnan(found[0]["c8", "c9"][2]) and found[0]["c2", "c3"] == (None, pytest.approx(found[0]["c0", "c3"][1]), None)
    monkeypatch.setattr(stats, "_PAIRS_IN_ONE_AGG", 0)
    clean = [c for c in cols if c not in ("c2", "c4", "c8")]
    assert "c1" not in scale.independent_columns(df, clean) and len(scale.independent_columns(df, clean)) == len(clean) - 1
    assert {r["corr"] for r in stats.corr_matrix(df, clean).filter("col_i = 'c1'").collect()} == {None}


def test_gram_moments_leave_out_gaps(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([None, 1.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    n, mean, gram = stats.gram_moments(df, "v")
    assert n == 2 and mean.tolist() == [2.0, 3.5] and gram.tolist() == [[2.0, 3.0], [3.0, 4.5]]


@pytest.mark.parametrize("values", [[0, 1], [5], [1, 1, 1, 2], list(range(7)), [0, 0, 0, 0, 1, 9], [-1.5, 2.5, 2.5]])
def test_rank_search_ends_on_ties(spark, values):
    """Flags, constants and heavy ties at every kind of border, with small limits."""
    import itertools

    column = sorted(itertools.islice(itertools.cycle(values), 600))
    df = spark.createDataFrame([(float(v),) for v in column] + [(None,)], "x double").repartition(3)
    edges = [i for i in range(1, 600) if column[i] != column[i - 1]]
    for rank in sorted({0, 1, 299, 300, 301, 599, *edges[:3], *(e - 1 for e in edges[:3])}):
        value, below, equal = quantiles.find_rank(df, "x", rank, small=2)
        assert (value, below, equal) == (column[rank], column.index(column[rank]), column.count(column[rank]))


def test_quantiles_of_flags(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_FETCH_ROWS", 10)
    monkeypatch.setattr(quantiles, "FINAL", 2)
    df = spark.range(1000).select((F.col("id") % 2).cast("double").alias("flag"), (F.col("id") % 4 == 0).cast("double").alias("rare"), F.lit(3.0).alias("same"))
    got = quantiles.exact_quantiles(df, ["flag", "rare", "same"], [0.0, 0.25, 0.5, 0.75, 1.0], small=50)
    assert got == {"flag": [0, 0, 0.5, 1, 1], "rare": [0, 0, 0, 0.25, 1], "same": [3] * 5}


def test_whitened_covariance_is_identity(spark):
    x, df = matrix(spark)
    pca = scale.fit_pca(df, "v", 4)
    w = np.array([r["whitened"] for r in pca.whiten(df, "v").collect()])
    assert np.allclose(np.cov(w, rowvar=False), np.eye(4), atol=1e-8)
    assert (pca.parts[np.arange(4), np.abs(pca.parts).argmax(axis=1)] > 0).all()
    full = scale.fit_pca(df, "v", 6)
    back = {r["id"]: r["reconstructed"] for r in full.reconstruct(df, "v").collect()}
    assert np.allclose([back[i] for i in range(len(x))], x)


def test_independent_columns(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 1e6).alias("b"), F.lit(3.0).alias("c"), F.pow("id", F.lit(2)).alias("d")
    )
    assert scale.independent_columns(df, ["a", "b", "c", "d"]) == ["a", "d"]


def test_feature_clusters_pick_one_of_each_kind(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 3))
    x = np.repeat(base, 4, axis=1) + rng.normal(scale=1e-3, size=(200, 12))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    assert sorted(p // 4 for p in scale.feature_clusters(df, "v", 3, 3)) == [0, 1, 2]


def test_mutual_info_of_copy_and_noise(spark):
    df = spark.range(4000).select(
        (F.col("id") % 10).cast("double").alias("same"), hashing.uniform("id", 1).alias("noise"), F.lit(1.0).alias("fixed"), (F.col("id") % 10).alias("y")
    )
    got = {r["column"]: r["mi"] for r in stats.mutual_info(df, ["same", "noise", "fixed"], "y").collect()}
    assert got["same"] == pytest.approx(math.log(10)) and got["noise"] < 0.05 and got["fixed"] == pytest.approx(0)


def test_histogram_top_edge_and_zero_column(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1), (10.0, 0.0, 1), (5.0, 0.0, 0)], "x double, z double, y int")
    got = {(r["column"], r["y"], r["bin"]): r["n"] for r in stats.histogram_by_class(df, ["x", "z"], "y", 10).collect()}
    assert got == {("x", 1, 0): 1, ("x", 1, 9): 1, ("x", 0, 5): 1}


def test_corr_with_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    got = {(r["col_i"], r["col_j"]): r["corr"] for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1) and got[("a", "c")] is None


def test_sigmoid_and_clip(spark):
    assert one(spark, maths.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, maths.clip_log(F.lit(0.0))) == pytest.approx(math.log(1e-15))
    assert one(spark, maths.ratio_squared(F.lit(1.0), F.lit(0.0), 0.0)) == 0.0


def near_info(x, y, k=3):
    """Ross's estimator by all distances."""
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    good = [i for i in range(len(x)) if x[i] is not None and not math.isnan(x[i]) and y[i] is not None]
    good = [i for i in good if sum(y[j] == y[i] for j in good) > 1]
    out = []
    for i in good:
        d = sorted(abs(x[i] - x[j]) for j in good if j != i and y[j] == y[i])
        r = d[min(k, len(d)) - 1]
        m = sum(abs(x[j] - x[i]) < r or x[j] == x[i] for j in good)
        out.append(psi(min(k, len(d))) - psi(len(d) + 1) - psi(m))
    return max(0.0, psi(len(good)) + sum(out) / len(out))


@pytest.mark.parametrize("range_rows", [250_000, 40])
def test_mutual_info_neighbors_equals_brute_force(spark, range_rows):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 240).tolist()
    cols = {"near": [float(v + 0.3 * rng.normal()) for v in y], "noise": rng.normal(size=240).tolist(), "ties": [float(round(v + rng.normal())) for v in y], "holes": [float(v) if i % 5 else None for i, v in enumerate(rng.normal(size=240))]}
    cols["holes"][1] = float("nan")
    y[7], y[8] = None, 9
    rows = [(y[i], *[c[i] for c in cols.values()], None) for i in range(240)]
    df = spark.createDataFrame(rows, "y int, near double, noise double, ties double, holes double, empty double")
    got = {r["column"]: r["mi"] for r in stats.mutual_info_neighbors(df, [*cols, "empty"], "y", 3, range_rows).collect()}
    assert set(got) == set(cols)
    for name, values in cols.items():
        assert got[name] == pytest.approx(near_info(values, y), abs=1e-9), name
    assert got["near"] > 0.7 > 0.1 > got["noise"]


def test_digamma(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (2,), (20,), (21,), (1000,)], "n long").select(stats.digamma(F.col("n"))).collect()]
    assert np.allclose(got, [sum(1 / i for i in range(1, n)) - 0.5772156649015329 for n in (1, 2, 20, 21, 1000)], atol=1e-10)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "x double, z double, y int")
    assert stats.histogram_by_class(df, ["x", "z"], "y").count() == 0
    assert stats.mutual_info(df, ["x", "z"], "y").count() == 0
    assert stats.mutual_info_neighbors(df, ["x"], "y").count() == 0


@pytest.mark.parametrize("small", [10, 100_000])
def test_quantiles_pass_over_nan(spark, small):
    from tabflow.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(size=3000)] + [1.0] * 200
    rows = [(v,) for v in x] + [(float("nan"),)] * 900 + [(None,)] * 100
    df = spark.createDataFrame(rows, "v double").withColumn("n", F.lit(float("nan")))
    got = exact_quantiles(df, ["v", "n"], [0.1, 0.82, 0.95, 1.0], small)
    assert got["v"] == pytest.approx(np.quantile(x, [0.1, 0.82, 0.95, 1.0]).tolist())
    assert got["n"] == [None] * 4

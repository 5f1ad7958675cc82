"""Positions, prefix sums, folds and splits, also when forced through many ranges."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabflow.operators import rows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [(i, "hot" if rng.random() < 0.4 else f"s{rng.randrange(20)}", rng.randrange(300) / 10, float(rng.randrange(100))) for i in range(2000)]
    return spark.createDataFrame(data, "id long, series string, t double, v double").repartition(7).cache()


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_global_index_same_for_one_and_many_ranges(skewed):
    want = {r[0]: i for i, r in enumerate(sorted(plain(skewed), key=lambda r: (r[2], r[0])))}
    for size in (10_000, 150):
        got = rows.row_index(skewed, ["t", "id"], range_rows=size)
        assert got.columns == ["id", "series", "t", "v", "idx"]
        assert {r["id"]: r["idx"] for r in got.collect()} == want


def test_series_index_with_hot_series(skewed):
    want = {}
    for r in sorted(plain(skewed), key=lambda r: (r[1], r[2], r[0])):
        want.setdefault(r[1], []).append(r[0])
    got = rows.row_index(skewed, ["t", "id"], "i", ["series"], range_rows=100).collect()
    assert len(got) == 2000
    assert all(want[r["series"]][r["i"]] == r["id"] for r in got)


def test_hot_series_is_spread(skewed):
    cut, ranges = rows.with_ranges(skewed, "id", 100)
    biggest = cut.groupBy("series", "__range").count().agg(F.max("count")).first()[0]
    assert ranges == 50
    assert biggest <= 130


def test_text_order(spark):
    words = [(f"{'ab' * (i % 3)}é{i:04d}",) for i in range(900)]
    df = spark.createDataFrame(words, "w string")
    got = rows.row_index(df, ["w"], range_rows=90)
    assert [r["w"] for r in sorted(got.collect(), key=lambda r: r["idx"])] == sorted(w[0] for w in words)


def test_null_series_gets_no_index(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, None)], "id long, s string")
    for size in (10, 1):
        got = {r["id"]: r["idx"] for r in rows.row_index(df, ["id"], partition_by=["s"], range_rows=size).collect()}
        assert got == {1: None, 2: 0, 3: 1, 4: None}


def test_null_and_nan_order_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, float("inf")), (5, -1.0), (6, 2.0)], "id long, x double")
    want = {2: 0, 5: 1, 6: 2, 1: 3, 4: 4, 3: 5}
    for size in (100, 2):
        assert {r["id"]: r["idx"] for r in rows.row_index(df, ["x", "id"], range_rows=size).collect()} == want


def test_prefix_sums(skewed):
    total, want = 0.0, {}
    for r in sorted(plain(skewed), key=lambda r: r[0]):
        total += r[3]
        want[r[0]] = total
    for size in (10_000, 130):
        got = rows.prefix_sums(skewed, ["id"], {"s": F.col("v")}, range_rows=size)
        assert {r["id"]: r["s"] for r in got.collect()} == want


def test_min_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5), (4, None), (5, 0.1)], "id long, s double")
    got = {r["id"]: r["rank"] for r in rows.min_rank(df, "s").collect()}
    assert (got[2], got[1], got[3], got[5], got[4]) == (1, 2, 2, 4, None)


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (20, 6), (3, 5)])
def test_contiguous_fold_sizes(spark, n, k):
    got = rows.contiguous_folds(spark.range(n), ["id"], k).collect()
    sizes = [sum(r["fold"] == i for r in got) for i in range(k)]
    assert sizes == [n // k + (i < n % k) for i in range(k)]
    assert [r["fold"] for r in sorted(got)] == sorted(r["fold"] for r in got)


def test_tumbling_drops_unfinished_block(spark):
    df = spark.createDataFrame([(i, "a" if i < 13 else "b") for i in range(17)], "id long, s string")
    got = rows.tumbling(df, ["id"], 5, ["s"]).collect()
    assert sorted((r["id"], r["window_id"]) for r in got) == [(i, i // 5 + 1) for i in range(10)]
    assert rows.tumbling(df, ["id"], 5).agg(F.max("window_id"), F.count("*")).first()[:] == (3, 15)


def test_head_tail_and_inclusive_split(spark):
    df = spark.range(11)
    head, tail = rows.head_tail(df, ["id"], 3, range_rows=4)
    assert sorted(r.id for r in head.collect()) == list(range(8))
    assert sorted(r.id for r in tail.collect()) == [8, 9, 10]
    first, second = rows.split_at(df, ["id"], 4, range_rows=4)
    assert first.count() == 5 and second.count() == 7


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 120), share=st.sampled_from([0.1, 0.2, 0.5]), seed=st.integers(0, 9))
def test_random_split_size_is_exact(spark, n, share, seed):
    import math

    got = rows.split_random(spark.range(n), "id", share, seed).agg(F.sum("is_test"), F.count("*")).first()
    assert tuple(got) == (math.ceil(round(share * n, 9)), n)


def test_splits_do_not_depend_on_layout(spark):
    df = spark.range(500).withColumn("label", F.col("id") % 3)

    def marks(part):
        return sorted(map(tuple, rows.split_random(part, "id", 0.1).collect())), sorted(
            map(tuple, rows.split_stratified(part, "id", "label", 0.2, range_rows=60).collect())
        )

    assert marks(df.repartition(1)) == marks(df.repartition(7))


def test_stratified_folds_keep_shares(spark):
    df = spark.range(400).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    counts = rows.stratified_folds(df, "id", "label", 8, range_rows=50).groupBy("fold").agg(F.sum("label"), F.count("*")).collect()
    assert len(counts) == 8
    assert all(12 <= c[1] <= 13 and 49 <= c[2] <= 51 for c in counts)


@pytest.mark.parametrize("leads", [[0.0, 1.0], [5.0], [0.0, 1.0, 1.0, 2.0] * 40 + [float("nan")], [0.0, 0.0, 0.0, 1.0, 2.0, None, None], [None], [float(i) for i in range(40)] + [7.0] * 60])
def test_tied_leading_key_is_spread(spark, leads):
    rng = random.Random(7)
    data = [(rng.choice(leads), None if rng.random() < 0.02 else float("nan") if rng.random() < 0.02 else rng.randrange(1500) / 8, i) for i in range(6000)]
    df = spark.createDataFrame(data, "a double, b double, id long").repartition(5)
    cut, ranges = rows.with_ranges(df, ["a", "b", "id"], 300)
    sizes = {r[0]: r[1] for r in cut.groupBy("__range").count().collect()}
    assert max(sizes) < ranges and max(sizes.values()) <= 900

    def order(v):
        return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)

    want = {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (order(r[0]), order(r[1]), r[2])))}
    assert {r["id"]: r["idx"] for r in rows.row_index(df, ["a", "b", "id"], range_rows=300).collect()} == want

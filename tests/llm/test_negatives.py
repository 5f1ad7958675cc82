import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm.negatives import cell_bounds, hard_negatives, score_bounds


def brute(rows, each, positives=5, negatives=5, percent=80):
    held = []
    for k, v, label in rows:
        if k is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        held.append((k, label, [math.floor(256 * c) for c in v]))
    out = []
    for i, (k, label, q) in enumerate(held):
        if k % each:
            continue
        score = [sum(x * y for x, y in zip(q, other, strict=False)) for _, _, other in held]
        same = sorted((j for j in range(len(held)) if j != i and held[j][1] == label), key=lambda j: (-score[j], held[j][0]))[:positives]
        for p in same:
            good = [j for j in range(len(held)) if held[j][1] != label and percent * score[p] <= 100 * score[j] <= 100 * score[p]]
            for r, j in enumerate(sorted(good, key=lambda j: (-score[j], held[j][0]))[:negatives]):
                out.append((k, held[p][0], r + 1, held[j][0], score[p], score[j]))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, x, d = rng.normal(size=(40, 5)), rng.normal(size=(300, 5)) * rng.uniform(0, 9, size=(300, 1)), rng.normal(size=(3, 5))
    x[:20] = a[:20] * 2
    x[20:40] = -a[20:40]
    angle = lambda u: np.arccos(np.clip((u / np.linalg.norm(u, axis=1)[:, None]) @ (d / np.linalg.norm(d, axis=1)[:, None]).T, -1, 1)).astype(np.float32)
    sizes = np.linalg.norm(a, axis=1), np.linalg.norm(x, axis=1)
    low, high = score_bounds(angle(a), angle(x), *sizes)
    score = a @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high - low < 0.8 * 2 * np.outer(*sizes)).mean() > 0.5
    parts = [slice(0, 100), slice(100, 300)]
    ends = [np.array([f(angle(x)[p], axis=0) for p in parts]) for f in (np.min, np.max)]
    low, high = cell_bounds(angle(a), *ends, sizes[0], np.array([sizes[1][p].max() for p in parts]))
    for j, p in enumerate(parts):
        assert (low[:, j, None] <= score[:, p]).all() and (score[:, p] <= high[:, j, None]).all()


def crowd(seed, dims, labels):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims))
    x = centre[rng.integers(0, 6, 260)] + 0.4 * rng.normal(size=(260, dims))
    x[:40] = x[0]
    x[200:] = np.round(x[200:])
    key = rng.permutation(900)[:260] - 30
    return [(int(k), v.tolist(), int(rng.integers(labels))) for k, v in zip(key, x, strict=True)]


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 9, "visit_rows": 6}])
@pytest.mark.parametrize(("dims", "labels"), [(2, 2), (3, 30), (16, 4)])
def test_crowd_equals_brute_force(spark, dims, labels, sizes):
    rows = crowd(dims, dims, labels)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    want = brute(rows, 10)
    assert len(want) > 20
    assert result(hard_negatives(df, F.col("vec_id") % 10 == 0, **sizes)) == want


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.9, 0.5], 2), (7, [0.0, 0.0], 1), (8, [-1.0, -0.5], 1), (9, [0.0, 0.0], 2), (10, [1.0, nan], 1), (11, [1.0, None], 2), (12, None, 2), (13, [], 2),
            (None, [1.0, 0.5], 2), (14, [1.0, 0.5], None), (15, [1.0], 2), (16, [0.9, 0.4, 5.0], 3), (17, [float("inf"), 0.0], 2), (18, [1.0, 0.45], 2), (18, [1.0, 0.45], 2), (20, [-1.0, -0.5], 4), (30, [1e6, 1e6], 4), (31, [1e6, 9e5], 5),
            (32, [1e6, 1.1e6], 4)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int").withColumn("row", F.lit("x")).withColumn("score", F.lit(None).cast("double")).withColumn("key", F.lit(1))
    out = hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert result(out) == brute(rows, 10)
    assert out.dtypes == [("anchor_id", "int"), ("positive_id", "int"), ("rank", "int"), ("negative_id", "int"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert result(hard_negatives(df.withColumn("embedding", F.expr("transform(embedding, x -> x * 3)")), F.col("vec_id") % 10 == 0)) == brute([(k, v and [c if c is None else c * 3 for c in v], x) for k, v, x in rows], 10)
    huge = df.limit(0).select("vec_id", "embedding", "label").union(spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 1), (2, [1.0], 2)], "vec_id int, embedding array<double>, label int"))
    assert hard_negatives(huge, F.col("vec_id") == 0).count() == 0
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.lit(None).cast("boolean")).count() == 0

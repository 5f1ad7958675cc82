import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm.vectors import linked_vectors


def brute(rows, least=0.95):
    """Links by all cosines, components by walking them."""
    width = max([len(v) for _, v in rows if v] or [1])
    good, u = [], []
    for _, v in rows:
        x = np.zeros(width)
        ok = bool(v) and all(c is not None and math.isfinite(c) for c in v)
        if ok:
            x[: len(v)] = v
            ok = bool(np.any(x))
        good.append(ok)
        u.append(x / np.abs(x).max() if ok else x)
    u = np.array(u)
    size = np.sqrt((u * u).sum(1))
    cosine = (u @ u.T) / np.where(np.outer(size, size) > 0, np.outer(size, size), 1)
    link = (cosine >= least) & np.outer(good, good)
    np.fill_diagonal(link, False)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                for j in np.nonzero(link[todo.pop()])[0].tolist():
                    if j not in part:
                        part.add(j)
                        todo.append(j)
            keys = [rows[j][0] for j in part if rows[j][0] is not None]
            for j in part:
                seen[j] = min(keys) if keys else None
        out.append((rows[i][0], int(link[i].sum()), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SMALL = [{}, {"cell_rows": 20, "piece_rows": 7, "visit_rows": 11}, {"cell_rows": 3, "piece_rows": 50, "sample": 40}]


def crowd(dims, seed):
    """Loose rows, tight and loose groups, exact copies, chains that hang together, and scaled rows."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(60, dims))]
    for size, noise in ((70, 0.02), (40, 0.15), (30, 0.24)):
        parts.append(rng.normal(size=dims) + noise * rng.normal(size=(size, dims)))
    a, b = rng.normal(size=(2, dims))
    parts.append(np.array([math.cos(t) * a / np.linalg.norm(a) + math.sin(t) * b for t in np.arange(0, 1.5, 0.08)]))
    parts += [np.repeat(parts[1][:2], 9, axis=0), parts[2][:5] * 1e-200, parts[2][5:9] * 1e200]
    x = np.concatenate(parts)
    keys = rng.permutation(len(x) * 2)[: len(x)]
    return [(int(k), [float(c) for c in v]) for k, v in zip(keys, x, strict=True)]


@pytest.mark.parametrize("sizes", SMALL)
@pytest.mark.parametrize("dims", [2, 3, 16])
def test_crowd_equals_brute_force(spark, dims, sizes):
    rows = crowd(dims, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = brute(rows)
    assert sum(r[1] for r in want) > 500
    assert result(linked_vectors(df, **sizes)) == want


@pytest.mark.parametrize("sizes", SMALL[:2])
def test_edges(spark, sizes):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [2.0, 0.0]), (None, [-1.0, 0.0]), (7, None), (7, []), (8, [0.0, -0.0]), (9, [1.0, None]), (10, [1.0, nan]),
            (11, [inf, 1.0]), (12, [1.0]), (13, [1.0, 0.0, 0.01]), (14, [-0.0, 5e-324]), (15, [0.95, math.sqrt(1 - 0.95**2)]), (16, [-1.0, -1.0]), (17, [1e308, -1e308]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").withColumn("label", F.lit(None).cast("int")).withColumn("node", F.lit("x")).withColumn("key", F.lit(3))
    out = linked_vectors(df, **sizes)
    got = result(out)
    want = [(k, n, c, k == c) for k, n, c, _ in brute(rows)]
    assert got == sorted(want, key=str)
    assert out.dtypes == [("vec_id", "int"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert linked_vectors(df.limit(0)).count() == 0
    assert linked_vectors(df.filter("embedding is null")).count() == 2


def test_tight_group_is_linear(spark):
    """Rows that a task reads grow with the size of a tight group, not with its square."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=8) + 0.01 * rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = linked_vectors(df, piece_rows=100).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(2999, 0)} and sum(r.kept for r in rows) == 1

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm.runs import find_runs, looped, periodic_runs


def brute(words):
    """All runs by comparing words every period apart."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_row(text, key=None, loop=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if loop and key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def rows_of(df):
    return [(r.doc_id, tuple(r)[1:8]) for r in df.collect()]


@pytest.mark.parametrize("seed", range(60))
def test_random_words_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randrange(1, 6)):
        w = [rng.randrange(1 + seed % 4) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            root = [rng.randrange(1 + seed % 5) for _ in range(rng.randrange(1, 25))]
            w += (root * 9)[: rng.randrange(1, 9 * len(root))] + [rng.randrange(3) for _ in range(rng.randrange(4))]
        texts.append(w)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    owner, start, length, period = find_runs(np.array([x for t in texts for x in t], np.int64), starts)
    got = sorted(zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert got == sorted((i, *r) for i, t in enumerate(texts) for r in brute(t))


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 6000")
    got = dict(rows_of(periodic_runs(looped(docs))))
    want = {r.doc_id: brute_row(r.text, r.doc_id, True) for r in docs.collect()}
    assert got == want
    assert sum(x[0] > 0 for x in want.values()) > 50


def test_edges(spark):
    root = " ".join(f"w{i}" for i in range(500))
    rows = [(1, None), (1, ""), (None, " \t\n"), (None, "a " * 5), (2, "a " * 6), (2, "a " * 6), (3, "a b " * 4), (4, "a b " * 3), (5, f"x {root} " + f"{root} " * 4 + "w0 w1 y"),
            (6, "é ü  " * 9), (7, "a " * 2_000), (8, "a a a a a a b " * 5), (9, ("a " * 7 + "b ") * 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("start", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n_runs", F.lit(None).cast("int"))
    out = periodic_runs(docs, with_runs=True, with_text=True)
    assert sorted(((r.doc_id, tuple(r)[1:8]) for r in out.collect()), key=str) == sorted(((k, brute_row(t)) for k, t in rows), key=str)
    held = {r.doc_id: r for r in out.filter("doc_id in (5, 7)").collect()}
    assert [tuple(x) for x in held[5].runs] == [(1, 2502, 500)] and held[5].collapsed.split()[-1] == "y"
    assert tuple(held[7])[1:6] == (1, 0, 2_000, 1, 2_000_000) and held[7].collapsed == "a"
    assert periodic_runs(docs.limit(0)).count() == 0
    assert looped(docs.limit(0)).count() == 0
    assert dict(periodic_runs(docs).dtypes)["doc_id"] == "int"

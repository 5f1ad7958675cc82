import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabflow.llm.substrings import COVER, PERIOD, repeated_windows

FOLDER = "/root/testdata/sf0.01"


def brute(rows, n=20):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            least[x] = min(least.get(x, float("inf")), float("inf") if k is None else k)
    out = []
    for (k, _), w in zip(rows, split, strict=True):
        gone, seen = set(), set()
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            if x in seen or least[x] < (float("inf") if k is None else k):
                gone.update(range(i, i + n))
            seen.add(x)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60_000])
def test_documents_equal_brute_force(spark, block_bytes):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(x[2] for x in want) > 1000
    assert result(repeated_windows(docs, block_bytes=block_bytes)) == want


def crowd():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50)}"
    parts = [[word() for _ in range(n)] for n in (19, 20, 21, 25, 33, 60)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 6)):
            w += [word() for _ in range(rng.randrange(0, 15))] + rng.choice(parts)
        rows.append((rng.randrange(-50, 60), " ".join(w)))
    a = "a " * 50
    return [*rows, (None, rows[0][1]), (None, rows[0][1]), (None, a), (5, a), (5, a), (7, a * 400), (8, None), (9, ""), (10, " \t\n"), (11, "é" * 9), (-(2**62), " ".join(parts[5])), (2**62, " ".join(parts[5]))]


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_crowd_equals_brute_force(spark, block_bytes):
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("key", F.lit(1))
    assert result(repeated_windows(docs, block_bytes=block_bytes)) == brute(rows)


def test_text_and_empty(spark):
    w = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {w}"), (2, f"y\n{w}  z")], "doc_id int, text string")
    assert [(r.doc_id, r.text) for r in repeated_windows(docs, with_text=True).orderBy("doc_id").collect()] == [(1, f"x {w}"), (2, "y z")]
    assert repeated_windows(docs.limit(0)).count() == 0

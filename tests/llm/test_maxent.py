import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabflow.llm import maxent as M
from tabflow.llm.maxent import lm_scores
from tabflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, learnt):
    counts = Counter()
    for (_, t), y in zip(rows, learnt, strict=True):
        if y:
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for k, t in rows:
        words = [*split(t), None]
        out.append((k, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 4)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op2_maximum_entropy"](spark, FOLDER).cache()


def test_base_equals_brute_force(spark, scored):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(scored) == brute(rows, [zlib.crc32(str(k).encode()) % 10 != 0 for k, _ in rows])
    assert {r.doc_id for r in scored.filter("held_out").collect()} == {k for k, _ in rows if zlib.crc32(str(k).encode()) % 10 == 0}


def test_better_than_base_on_held_out(scored):
    row = scored.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert row.s > row.b + 0.03 * row.n


EDGES = [(None, None), (1, None), (2, ""), (3, "A b C é É x"), (4, "the " * 30_000), (5, "the cat."), (5, "the cat."), (6, " \n"), (7, "x" * 100_000)]


def test_edges(spark):
    rows = [*EDGES, *((100 + i, f"the cat{i % 7} sat on the mat{i % 5}. and so on") for i in range(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("learn", F.col("doc_id") != 3).withColumn("key", F.lit("clash"))
    got = lm_scores(docs, block_bytes=1000)
    assert result(got) == brute(rows, [k is not None and k != 3 for k, _ in rows])
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in got.collect())
    nothing = lm_scores(docs.withColumn("learn", F.lit(False)))
    assert result(nothing) == brute(rows, [False] * len(rows))
    assert lm_scores(docs.limit(0)).count() == 0


def test_probabilities_add_up(spark):
    """After any context, all tokens of the vocabulary and the unseen ones of each form have probability 1 together."""
    text = ["the cat sat. on the mat, the dog é êtes là. w%d x%d." % (i, i % 30) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").withColumn("learn", F.lit(True))
    rows = docs.select(F.col("text"), F.lit(0).cast("long").alias("block"), "learn")
    v = M.vocabulary(M._counts(rows, 1))
    w = M.train(rows, v)
    assert v.total == sum(len(split(t)) + 1 for t in text)
    counts = Counter(x for t in text for x in split(t))
    words = list(counts)
    for before in ("", "the", "on the", "là."):
        total = 0.0
        for word in [*words, None, "unseen", "unseen.", "ünseen", "ünseen."]:
            t = M.tokens(pa.array([f"{before} {word}" if word else before], pa.large_string()))
            known = np.array([next((n for x, n in counts.items() if M.W.word_hashes(pa.array([x]))[0] == h), 0) for h in t.hashes])
            at = len(split(before))
            total += 10 ** M.token_scores(w, v, t, known)[at]
        assert total == pytest.approx(1, abs=1e-4)


def test_training_lowers_the_loss(spark):
    text = ["a b c d e f g h i j k l"] * 6000 + ["b a d c f e h g j i l k"] * 6000
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").withColumn("learn", F.lit(True))
    row = lm_scores(docs.coalesce(1)).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > 0.4 * row.b


def test_every_round_reads_all_texts(spark):
    """Equal texts are read in the second round, too."""
    docs = spark.createDataFrame([(i, "a b c d a b c e") for i in range(50)], "doc_id long, text string").coalesce(1)
    v = M.vocabulary(M._counts(docs.select("text", F.lit(0).cast("long").alias("block"), F.lit(True).alias("learn")), 1))
    once, twice = M.train(docs, v, 1), M.train(docs, v, 2)
    assert np.abs(once.outer - twice.outer).max() > 1e-3


def test_end_is_frequent_however_rare(spark):
    text = " ".join(f"w{i % 400}" for i in range(2000))
    docs = spark.createDataFrame([(0, text, True), (1, text, True)], "block long, text string, learn boolean")
    v = M.vocabulary(M._counts(docs, 1))
    assert v.total == 4002 and v.distinct == 401
    assert M.END in v.heads and len(v.heads) == sum(M.CLASSES)
    # Words beyond the classes keep their counts.
    assert v.rest_total.sum() == 4002 - 10 * (len(v.heads) - 1) - 2 and v.rest_distinct.sum() == 401 - len(v.heads)


def test_rare_words_follow_their_context(spark):
    """A word beyond the classes is likelier after the word that it always follows, at the same count, and all of them still add up to 1."""
    text = [f"a{i % 200} b{i % 200}" for i in range(40_000)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").withColumn("learn", F.lit(True)).coalesce(1)
    rows = docs.select("text", F.lit(0).cast("long").alias("block"), "learn")
    v = M.vocabulary(M._counts(rows, 1, 2))
    assert v.depth == 2 and v.cell_total.sum() == v.rest_total.sum() and v.cell_distinct.sum() == v.rest_distinct.sum()
    w = M.train(rows, v)
    rare = [i for i in range(200) if not np.isin(M.W.word_hashes(pa.array([f"b{i}"])), v.heads)[0]]
    assert len(rare) > 30

    def score(i, j):
        t = M.tokens(pa.array([f"a{i} b{j}"], pa.large_string()))
        return M.token_scores(w, v, t, np.full(len(t.hashes), 200))[1]

    gain = [score(i, i) - score(j, i) for i, j in zip(rare[:-1], rare[1:], strict=True)]
    assert np.mean(gain) > 0.2 and np.mean(np.array(gain) > 0) > 0.8


def test_levels_grow_with_the_texts():
    assert [M.levels(n) for n in (0, 1 << 20, 1 << 24, 1 << 28, 1 << 35)] == [1, 1, 2, 3, 5]

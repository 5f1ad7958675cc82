import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabflow.llm import crf
from tabflow.llm.crf import fit_languages, languages, marginals, remainder
from tabflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return fit_languages(docs, learn=remainder(F.col("doc_id"), 3) != 1)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    starts, sizes = np.array([0, 5, 6]), np.array([5, 1, 6])
    want = np.zeros((12, 3))
    for lo, n in zip(starts, sizes, strict=True):
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(sum(scores[lo + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for i, y in enumerate(path):
                want[lo + i, y] += weight
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(marginals(scores, starts, sizes, moves), want)


def test_held_out_accuracy(spark, docs):
    rows = QUERIES["op3_random_field"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switching(spark, docs, model):
    texts = {r["lang"]: r.text.split()[:60] for r in docs.filter("doc_id > 500").filter(F.length("text") > 1500).collect()}
    mixed = texts["en"] + texts["de"] + texts["en"][:30]
    post, _, letters, _ = model.label(pa.array([" ".join(mixed)], pa.large_string()))
    want = np.array([model.labels.index(x) for x in ["en"] * 60 + ["de"] * 60 + ["en"] * 30])
    assert (post.argmax(axis=1) == want)[letters].mean() > 0.9
    row = languages(spark.createDataFrame([(" ".join(mixed),)], "text string"), model).first()
    assert row.lang_pred == "en" and row.lang_runs.startswith("en:0:") and "de:" in row.lang_runs


def test_stretches_join(docs, model):
    text = " ".join(r.text for r in docs.limit(60).collect())
    assert len(text.split()) > 5000
    post, starts, _, _ = model.label(pa.array([text, "", "the and"], pa.large_string()))
    assert len(post) == starts[-1] == len(text.split()) + 2 and np.allclose(post.sum(axis=1), 1)


def test_edges(spark, model):
    rows = [(None, None, None), (1, None, "en"), (2, "", "en"), (3, "12 34 ++  ", "en"), (4, "the of and " * 8000, None), (4, "the of and " * 8000, None), (5, "日本語", "xx"), (6, "é", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("draw", F.lit(1))
    out = languages(frame, model).collect()
    assert len(out) == len(rows)
    assert [r.lang_pred for r in out if r.doc_id in (None, 1, 2, 3)] == ["und"] * 4
    assert [r.lang_pred for r in out if r.doc_id == 4] == ["en", "en"]
    assert fit_languages(frame.filter("doc_id < 4")) is None and fit_languages(frame.limit(0)) is None
    assert [r.lang_pred for r in languages(frame, None).collect()] == ["und"] * len(rows)
    assert languages(frame, fit_languages(frame)).filter("doc_id = 5").first().lang_pred == "xx"
    assert languages(frame.limit(0), model).count() == 0


def test_every_label_is_learnt(spark):
    """Many labels, one of them of long texts only, with or without spaces."""
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choice(list(letters), 6)) for _ in range(12)] for k in range(120)}
    rows = [(i * 1000 + int(k[1:]), " ".join(rng.choice(w, 30)), k) for k, w in words.items() for i in range(3 if k != "l119" else 2)]
    rows += [(10_000, "12 " + "lang texte sind hier " * 3000, "long"), (10_001, "日本語" * 20_000, "wide")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs)
    assert model.labels == sorted([*words, "long", "wide"])
    texts = [(1, " ".join(words["l119"]), "l119"), (2, "hier sind lang texte", "long"), (3, "日本語日本語", "wide")]
    out = languages(spark.createDataFrame(texts, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == r["lang"] for r in out)


def test_words_are_scored_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{rng.integers(3000)}x{rng.integers(9)}" for _ in range(n)) for n in (0, 1, 400, 2500, 5000)] + ["", "12 34", "é ü"], pa.large_string())
    model = crf.Model(["a", "b"], rng.normal(size=(crf.BUCKETS, 2)).astype(np.float32), pa.array(["w1x1"], pa.large_string()), np.array([0]), np.eye(2, dtype=np.float32), rng.normal(size=(2, 2)), rng.random(crf.SEEN) < 0.5)
    want = model.label(texts)
    held = []
    for name in ("features", "seen_grams"):
        monkeypatch.setattr(crf, name, lambda words, f=getattr(crf, name): held.append(len(words)) or f(words))
    monkeypatch.setattr(crf, "LABEL_WORDS", 100)
    assert all(np.array_equal(a, b) for a, b in zip(model.label(texts), want, strict=True))
    assert len(held) > 20 and max(held) <= 100

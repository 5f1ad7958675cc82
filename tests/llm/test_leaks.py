import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabflow.llm import leaks as L
from tabflow.llm.leaks import decontaminated, indexes, leaked_items
from tabflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(index, text):
    """All passages against all units, without any bound."""
    words = [index.number.get(L.plain(w), -1) for w in text.split()]
    out = {}
    for lo in range(0, max(len(words), 1), L.STRIDE):
        held = {t for t in words[lo : lo + L.PASSAGE] if t >= 0}
        for unit, item in enumerate(index.item_of):
            score = sum(x for t in held for u, x in zip(*index.lists[t], strict=True) if u == unit)
            if score >= L.LEAST_SCORE - 1e-9:
                q, a = index.overlaps(item, words[max(0, lo - index.words[item]) : lo + L.PASSAGE + index.words[item]])
                if q >= L.LEAST_OVERLAP and a >= L.LEAST_OVERLAP:
                    out[item] = max(out.get(item, 0.0), score)
    return {i: round(s, 9) for i, s in out.items()}


@pytest.fixture(scope="module")
def index(spark):
    return next(indexes(spark.read.parquet(f"{FOLDER}/benchmark.parquet")))


def mixed(index, rng, items):
    """Texts that hold parts of items between words of other items."""
    pool = [w for _, t in items for w in t.split()]
    texts = []
    for _ in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 150))]
        own = rng.choice(items)[1].split()
        keep = rng.choice([1.0, 0.95, 0.8, 0.6, 0.4])
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + [w for w in own if rng.random() < keep] + words[at:]))
    return texts


def test_search_equals_brute_force(spark, index):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = [*mixed(index, rng, items), *(t for _, t in items), "", "a b c"]
    got = [{} for _ in texts]
    for d, item, _, score, _, _ in L.leaks(index, pa.array(texts, pa.large_string())):
        got[d][item] = round(score, 9)
    assert got == [brute(index, t) for t in texts]
    assert sum(map(len, got)) > 60


def test_documents(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(r.doc_id, r.item_id) for r in docs.select("doc_id", F.col("text").alias("t")).join(items, F.contains("t", "text")).collect()}
    got = {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()}
    assert want and got == want
    several = {(r.doc_id, r.item_id) for r in leaked_items(docs, items, most_units=15).collect()}
    assert several == want
    assert {r.doc_id for r in decontaminated(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edges(spark):
    rng = random.Random(4)
    long = " ".join(f"t{rng.randrange(3000)}" for _ in range(700))
    question = "What is the name of the river that runs through Elbonia and ends in the southern sea? It is the Muddy Wump river."
    items = spark.createDataFrame([(1, long), (2, question), (3, None), (4, ""), (5, "too short an"), (None, question)], "item_id long, text string").withColumn("words", F.lit("clash"))
    noise = " ".join(f"n{i}" for i in range(300))
    rows = [(1, f"{noise} {long} {noise}"), (2, f"{noise} {long[:len(long) // 3]} {noise}"), (3, question.upper()), (4, question.split("?")[0]), (5, None), (6, ""), (7, "the river is the name of the sea " * 30),
            (None, question), (3, f"{question}\n{question}"), (8, noise * 50), (9, f"{noise}\n{question.replace('runs', 'flows')} {noise}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit("clash"))
    found = sorted(((r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()), key=str)
    assert found == sorted([(1, 1), (3, 2), (3, None), (3, 2), (3, None), (None, 2), (None, None), (9, 2), (9, None)], key=str)
    assert sorted(r.doc_id for r in decontaminated(docs, items).collect()) == [2, 4, 5, 6, 7, 8]
    assert leaked_items(docs.limit(0), items).count() == leaked_items(docs, items.limit(0)).count() == 0
    assert decontaminated(docs, items.limit(0)).count() == len(rows)


def test_free_standing_signs(spark):
    items = spark.createDataFrame([(1, "What do we get ? x - y + z = 7 , or not : never"), (2, "Quelle est la somme de ces nombres ? 3 + 4")], "item_id long, text string")
    texts = [r.text for r in items.orderBy("item_id").collect()]
    docs = spark.createDataFrame([(1, f"some - words before ! {texts[0]} and after"), (2, texts[1]), (3, "x - y + z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_before, r.question_overlap, r.answer_overlap) for r in leaked_items(docs, items).collect())
    assert got == [(1, 1, 0, 1.0, 1.0), (2, 2, 0, 1.0, 1.0)]


def test_short_items(spark):
    items = spark.createDataFrame([(1, "3 + 4 = 7"), (2, "Muddy Wump?"), (3, "muddy wump"), (4, "Wump"), (5, "? !"), (6, "a longer item of more than five words. It stays as it is")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so - 3 + 4 = 7 ."), (2, "the MUDDY - Wump, the muddy wump"), (3, "wumps are muddy"), (4, "ends with muddy"), (5, "wump begins"), (6, "3 4 8 7"), (7, "? !")], "doc_id long, text string").coalesce(1)
    want = [(1, 1, 2), (2, 2, 1), (2, 3, 1), (2, 4, 3), (5, 4, 0)]
    assert sorted((r.doc_id, r.item_id, r.n_before) for r in leaked_items(docs, items).collect()) == want
    assert sorted((r.doc_id, r.item_id, r.n_before) for r in leaked_items(docs, items.filter("item_id < 6")).collect()) == want
    assert sorted(r.doc_id for r in decontaminated(docs, items, most_units=1).collect()) == [3, 4, 6, 7]


def test_passages_of_long_items(spark, tmp_path):
    """The query and the stage of the pipeline find a part of a long item; an item of one unit still needs question and answer."""
    rng = random.Random(5)
    long = [f"t{rng.randrange(3000)}" for _ in range(700)]
    short = [f"s{i}" for i in range(20)]
    spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    noise = [f"n{i}" for i in range(200)]
    rows = [(1, noise + long[100:220] + noise), (2, noise + long[300:315] + noise), (3, noise + short[:12] + noise), (4, noise + short + noise), (5, noise), (6, long)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op9_block_max_wand"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (4, 2), (6, 1)]
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [2, 3, 5]

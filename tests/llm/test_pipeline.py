import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pathjoin import brute as classes_of
from test_pii import PLAIN
from tokenizers import Tokenizer

import corpus_pipeline
from tabflow.llm.queries import tokenizer_file

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out of the last."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    base = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, FOLDER).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return [*out, docs]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.dtypes == stages[0].dtypes for s in stages[:5])


def test_language_keeps_clean_documents(spark, stages):
    clean = ids(spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1"))
    assert len(clean - ids(stages[1])) <= len(clean) // 200


def test_one_of_each_group_stays(stages):
    want = {k for k, c, _, _ in classes_of([(r.doc_id, r.text) for r in stages[1].collect()]) if k == c}
    assert ids(stages[2]) == want


def test_no_item_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in stages[2].collect() if any(t in r.text for t in items)}
    assert gone and ids(stages[3]) == ids(stages[2]) - gone


def test_no_personal_data_stays(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[3:5])
    assert set(before) == set(after)
    changed = [k for k in before if before[k].text != after[k].text]
    assert changed
    for k, r in after.items():
        assert r.n_chars == len(r.text) and not re.search(PLAIN["email"], r.text)
        if k not in changed:
            assert r.lang == before[k]["lang"] and r.source == before[k].source
    assert any("<EMAIL>" in after[k].text for k in changed) and any("<PHONE>" in after[k].text for k in changed)


def test_ids(stages):
    reference = Tokenizer.from_file(tokenizer_file())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_nulls_and_repeats(spark):
    long = "The thing that was of the and in it is for the by ones with onething another words here to be long"
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, long, None, None, None), (None, long + " and", "en", "s", 1), (None, long, "en", "s", 1), (None, "der die das und ist nicht ein eine", "de", "s", 1), (None, None, None, None, None),
            (3, None, "en", "s", 0), (4, "12 34", "en", "s", 0), (None, "der die das und ist nicht ein eine", "de", "s", 1), (5, "der die das und ist nicht ein eine mit", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.deduplicate(spark, docs, FOLDER)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["1", "3", "4", "5", "None"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        assert stage(spark, docs, FOLDER).count() >= 0


def test_columns_of_any_name_stay(spark):
    names = ["mark", "_lang", "_score", "_runs", "lang_pred", "score", "lang_runs", "familiar", "base_found", "all_found", "key", "row", "item", "block", "text_1"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) > 30 and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)


def test_language_rejects_foreign_words_whatever_the_labels(spark):
    """A text of words like none learnt from goes, a text that mixes learnt languages stays, with one label as with four."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id > 500")
    odd = "qzxv kjwq xxqz vvkq zqjx wqqz kkxj " * 20
    for some in (docs.filter("lang = 'en'"), docs):
        mixed = " ".join(r.text for r in some.filter(F.length("text") > 800).orderBy("doc_id").limit(6).collect())
        extra = spark.createDataFrame([(-1, odd, None, "s", 1), (-2, mixed, None, "s", 1)], some.schema)
        kept = ids(corpus_pipeline.language(spark, some.unionByName(extra), FOLDER))
        assert -1 not in kept and -2 in kept

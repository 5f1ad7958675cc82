import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tabflow.llm.pii import KINDS, Model, fit_candidates, luhn, personal_data, redact, span_digest

FOLDER = "/root/testdata/sf0.01"
# The patterns as the contract spells them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_ok(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, found):
    d = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn_ok(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]
    line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return [sum(x[1] == i for x in spans) for i in range(4)], hashlib.sha256(line.encode()).hexdigest(), line


TEXTS = [
    None, "", "a@b.co", "x a@b.co.x@y.com z", "a@b.co_x@y.com", "a@b@c.de, %+@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 999.1.2.3.4", "4111 1111-1111 1111 and 4111111111111111 x 41111111111111112222222",
    "4111--1111 1111 1111 0000 0000 0000 0000", "12 -34 0000-0000-0000", "+1 (988) 555-2485 x +49 30 1234567890123456 +1", "+1+2 345 678 901 +3 (4) 5.6-7 8901 2 ) ", "𝒳日本 a@b.co é 10.0.0.1 𝒳 +33 1 23 45 67 89",
    "a@b.co " * 300, "9" * 20_000, "a" * 50_000 + "@", "1.2.3.4 " * 200 + "+12 3456789 " * 50, "1 2 " * 6000,
]


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    for r in span_digest(docs, Model()).collect():
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, r.spans) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    assert span_digest(docs.limit(0), Model()).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return fit_candidates(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_documents(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    plan = span_digest(docs, model)
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
    n = 0
    for r in plan.collect():
        counts, digest, line = brute(texts[r.doc_id])
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, digest)
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
        n += sum(counts)
    assert n > 20


def test_trees_add_spellings(spark, model):
    rows = [
        (0, "write to jane.doe [at] mail3.example.com soon"), (1, "or jane.doe (at) mail3 (dot) example (dot) com."), (2, "thing (988) 555-2485 or"), (3, "card 4111.1111.1111.1111 was"),
        (4, "on 2024-10-11 at 10:30, 3.14159 and 12,500 of 1984"), (5, "we met at noon. dot com was at an end"), (6, "4111.1111.1111.1112 is not one"), (7, "plain words only"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in span_digest(docs, model).collect()}
    assert found[0] == "email:9:40" and found[1].startswith("email:3:") and found[2] == "phone:6:20" and found[3].startswith("card:5:24")
    assert found[4] == found[5] == found[7] == ""
    assert "card" not in found[6]


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é a@b.co, +49 30 1234567 x", "en"), (2, None, None), (3, "none", "de")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in redact(docs, Model()).orderBy("doc_id").collect()] == [(1, "é <EMAIL>, <PHONE> x", "en"), (2, None, None), (3, "none", "de")]
    assert [len(r.all_found) for r in personal_data(docs, Model()).orderBy("doc_id").collect()] == [2, 0, 0]


def test_luhn(spark):
    numbers = ["", "0", "18", "4111111111111111", "4111111111111112", "79927398713"]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", luhn(F.col("n")).alias("ok")).collect()
    assert {r.n: r.ok for r in rows} == {n: bool(n) and luhn_ok(n) for n in numbers}


def test_fit_without_examples(spark):
    docs = spark.createDataFrame([(1, "no such thing"), (2, None)], "doc_id long, text string")
    assert fit_candidates(docs).trees == [] and fit_candidates(docs.limit(0)).trees == []


def test_all_texts_are_learnt_from(spark):
    """However many texts there are, and however long."""
    from tabflow.llm import pii

    long = "word " * 21_000
    docs = spark.range(3300).selectExpr("id as doc_id", "concat('mail a', id, '@b', id, '.org or 12', id, '-34-56-7') as text")
    assert pii._examples(docs, "doc_id", "text").agg(F.count_distinct("draw")).first()[0] == 3300
    wide = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit(long + "mail a"), F.col("id").cast("string"), F.lit("@b.org or 12-34-56-789 or "), F.lit("4111111111111111")).alias("text"))
    rows = pii._examples(wide, "doc_id", "text").collect()
    assert len({r.draw for r in rows}) == 12 and {r.kind for r in rows if r.label} == {0, 2}
    assert max(len(r.left) for r in rows) == pii.LEFT and max(len(r.right) for r in rows) == pii.RIGHT
    assert fit_candidates(wide).trees

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tabflow.llm.quality import compression_bands

FOLDER = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.length("text") < 4000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = compression_bands(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])


EDGES = [(None, None), (1, None), (2, ""), (3, "   \n\t"), (4, "a b c\u0085d \x1c e"), (5, "ab " * 3000), (6, "x" * 300_000),
         (7, "same line\n\n same line\nsame line\n"), (7, "same line\n\n same line\nsame line\n"), (8, "née <b> |x| 日本 𝒳 " * 3)]


def test_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("key", F.lit(1))
    rows = compression_bands(docs).collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in rows if r.doc_id not in (5, 6)) == sorted(str(brute(t)) for i, t in EDGES if i not in (5, 6))
    assert not any(r.kept for r in rows)
    assert compression_bands(docs.limit(0)).count() == 0


def noise(i):
    return base64.b64encode(hashlib.sha512(str(i).encode()).digest()).decode()


@pytest.mark.parametrize(("text", "kept"), [
    ("Buy now cheap pills and more 1. " * 8 + " ".join(f"w{i}" for i in range(4)), False),
    ("".join(f"page {i % 7} of list {i % 11} " for i in range(900)), False),
    (" ".join(map(noise, range(60))), False),
], ids=["copies", "repetitive", "incompressible"])
def test_verdicts(spark, text, kept):
    assert compression_bands(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().kept is kept


def test_keeps_clean_texts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    rows = compression_bands(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").filter("not base_failed")
    assert rows.count() > 200
    assert rows.filter("not kept").count() == 0

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

from tabflow.llm.bpe import Encoder, bpe_round_trip, tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    return Reference.from_file(FILE)


def wanted(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    decoded = reference.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_documents_equal_reference(spark, reference):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe_round_trip(docs, FILE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(reference, texts[r.doc_id])


def test_edges(spark, reference):
    texts = [None, "", " ", "aaaa aaaaaaa\n\n\n  x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|", "日本語 𝒳 é́", "x" * 20_000, "it's we'll I'D  z", "0123 4²½", "0123 4²½"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    for r in bpe_round_trip(docs, FILE).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(reference, texts[r.doc_id])
    assert bpe_round_trip(docs.limit(0), FILE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    reference = Reference.from_file(FILE) if not hasattr(test_any_text, "r") else test_any_text.r
    test_any_text.r = reference
    for text, ids in zip(texts, Encoder(tokenizer(FILE))(texts), strict=True):
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
        assert tokenizer(FILE).decode(ids.tolist()) == text

"""A corpus pipeline of five stages. Each takes (spark, docs, folder), works on all rows the stage before kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import queries as Q
from tabflow.llm.bpe import bpe_round_trip
from tabflow.llm.crf import UND, fit_languages, languages
from tabflow.llm.leaks import decontaminated
from tabflow.llm.pathjoin import near_duplicates
from tabflow.llm.pii import fit_candidates, redact
from tabflow.session import cut_lineage, forget, free_name, fresh_path

# A text is rejected if less than this share of its words' n-grams is known from the texts learnt from, in whatever language. The measure does not
# depend on the number of languages, and a text that mixes some stays.
LEAST_FAMILIAR = 0.5


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in languages that were learnt from their labels; those without a letter or of foreign words go."""
    names = tuple(free_name(docs.columns, c) for c in ("lang_pred", "score", "lang_runs", "familiar"))
    out = languages(docs, fit_languages(docs), out=names)
    return out.filter((F.col(names[0]) != UND) & (F.col(names[3]) >= LEAST_FAMILIAR)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; a row that repeats it goes, too."""
    classes = cut_lineage(near_duplicates(docs).select("doc_id", "mark", "is_first"))
    mark = free_name(docs.columns, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    gone = classes.filter("not is_first").select("doc_id", "mark").distinct()
    repeated = classes.filter("is_first").groupBy("doc_id", "mark").count().filter("count > 1").select("doc_id", "mark")
    if repeated.isEmpty():
        return _without(marked, mark, gone).select(*docs.columns)
    same = marked["doc_id"].eqNullSafe(repeated["doc_id"]) & (marked[mark] == repeated["mark"])
    once = marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", mark])
    return _without(marked, mark, gone.unionByName(repeated)).unionByName(once).select(*docs.columns)


def _without(marked: DataFrame, mark: str, gone: DataFrame) -> DataFrame:
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone["doc_id"]) & (marked[mark] == gone["mark"]), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of the benchmark, nor a passage of a long one."""
    return decontaminated(docs, Q.table(spark, folder, "benchmark"), in_part=True)


def remove_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    out = redact(docs, fit_candidates(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """BPE ids of every document, and the hashes of the round trip."""
    return bpe_round_trip(docs, Q.tokenizer_file(), with_ids=True).drop("decoded")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", remove_personal_data),
    ("BPE encoding and decoding", encode),
]

# Model verdicts and byte-pair ids are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what the next one has read is deleted."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            forget(spark, before)
        before = path
    return docs

"""The queries of this subpackage: (spark, folder) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# Words of every text, as SQL.
_WORDS = r"w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents)"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.quality import compression_bands

    return compression_bands(table(spark, folder, "documents"))


@query
def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, folder, "documents"), tokenizer_file())


@query
def op5_boosted_spans(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.pii import fit_candidates, span_digest

    docs = table(spark, folder, "documents")
    return span_digest(docs, fit_candidates(docs))


@query
def op6_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.urls import url_verdicts

    return url_verdicts(table(spark, folder, "pages"), table(spark, folder, "labels"))


@query
def op10_chosen_paths(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.pathjoin import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).drop("mark")


SQL["op10_chosen_paths"] = f"""with recursive {_WORDS},
    l as (select doc_id, list_sort(list_distinct(case when len(words) >= 5 then [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]
        when len(words) > 0 then [array_to_string(words, ' ')] else [] end)) as sh from w),
    g as (select sh, min(doc_id) as rep, count(*) as copies from l where len(sh) > 0 group by sh),
    u as (select rep, len(sh) as n, unnest(sh) as x from g),
    p as (select a.rep as a, b.rep as b from u a join u b on a.x = b.x and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n having 5 * count(*) >= 4 * (a.n + b.n - count(*))),
    reach(a, b) as (select rep, rep from g union select r.a, p.b from reach r join p on r.b = p.a),
    c as (select a as rep, min(b) as class_id from reach group by 1),
    k as (select a as rep, count(*) as n from p group by 1)
    select l.doc_id, coalesce(class_id, l.doc_id) as class_id, coalesce(k.n, 0) as n_links, coalesce(copies, 1) as n_copies, coalesce(class_id, l.doc_id) = l.doc_id as is_first
    from l left join g on l.sh = g.sh left join c on g.rep = c.rep left join k on g.rep = k.rep"""


@query
def op7_difference_cover(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.substrings import repeated_windows

    return repeated_windows(table(spark, folder, "documents"))


SQL["op7_difference_cover"] = f"""with {_WORDS},
    k as (select doc_id, i, array_to_string(words[i:i + 19], ' ') as t from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from w where len(words) >= 20)),
    f as (select doc_id, i, min(doc_id) over (partition by t) as first_doc, min(i) over (partition by t, doc_id) as first_i from k),
    c as (select distinct doc_id, unnest(range(i, i + 20)) as p from f where doc_id > first_doc or i > first_i),
    r as (select doc_id, count(*) as n from c group by 1),
    a as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p from w),
    s as (select a.doc_id, string_agg(word, ' ' order by a.p) as kept from a anti join c on a.doc_id = c.doc_id and a.p = c.p group by 1)
    select w.doc_id, len(words) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from w left join r on w.doc_id = r.doc_id left join s on w.doc_id = s.doc_id"""


@query
def op9_block_max_wand(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.leaks import leaked_items

    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"), in_part=True)


@query
def op3_random_field(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.crf import fit_languages, languages, remainder

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_languages(docs, learn=remainder(F.col("doc_id"), 3) != 1)
    return languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"]).drop("lang_runs", "familiar")


@query
def op2_maximum_entropy(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.crf import remainder
    from tabflow.llm.maxent import lm_scores

    rest = remainder(F.col("doc_id"), 10)
    docs = table(spark, folder, "documents").select("doc_id", "text", (rest != 0).alias("learn"), F.coalesce(rest == 0, F.lit(False)).alias("held_out"))
    return lm_scores(docs, keep=("held_out",))


@query
def op8_recurrent_blocks(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.pages import extracted, fit_pages

    pages = table(spark, folder, "pages")
    return extracted(pages, fit_pages(pages))


@query
def op11_basic_factors(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.runs import looped, periodic_runs

    return periodic_runs(looped(table(spark, folder, "documents")))


def _runs_sql(levels: int) -> str:
    """Runs of words for texts of up to ``2 ** (levels + 1)`` words, by hashes of factors of doubled length."""
    steps = [f"h{k + 1} as (select doc_id, i, n, hash(h, lead(h, {1 << k}) over (partition by doc_id order by i)) as h from h{k} where n >= {4 << k})" for k in range(levels)]
    near = " union all ".join(
        f"select doc_id, i, {1 << k} as w, lead(i) over (partition by doc_id, h order by i) - i as d from h{k} where i + {1 << k} <= n" for k in range(levels + 1)
    )
    return rf"""with {_WORDS},
    c as (select doc_id, words, len(words) as n, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) as crc from w),
    g as (select *, (crc // 10) % n as a, 1 + (n - (crc // 10) % n) // (3 + (crc // 10) % 8) as p from c where n > 0),
    v as (select doc_id, n, i, case when crc % 10 = 0 and i >= a then words[1 + a + (i - a) % p] else words[1 + i] end as word from (select *, unnest(range(n)) as i from g)),
    h0 as (select doc_id, i, n, hash(word) as h from v),
    {", ".join(steps)},
    s as (select *, i - row_number() over (partition by doc_id, w, d order by i) as part from ({near}) where d <= w),
    r as (select distinct doc_id, min(i) as start, count(*) + w - 1 + d as length, d as period from s group by doc_id, w, d, part having count(*) + w - 1 + d >= greatest(6, 4 * d)),
    b as (select doc_id, count(*) as n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'e': -length::double / period, 's': start, 'p': period}}) as best,
        string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines from r group by doc_id),
    x as (select v.doc_id, string_agg(word, ' ' order by i) as kept from v anti join r on v.doc_id = r.doc_id and v.i >= r.start + r.period and v.i < r.start + r.length group by v.doc_id)
    select c.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period, 1000 * best.l // best.p as exponent_milli,
        sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
    from c left join b on c.doc_id = b.doc_id left join x on c.doc_id = x.doc_id"""


SQL["op11_basic_factors"] = _runs_sql(15)


@query
def op12_metric_range(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.vectors import linked_vectors

    return linked_vectors(table(spark, folder, "embeddings"))


SQL["op12_metric_range"] = """with recursive v as (select vec_id, embedding::double[] as x from embeddings where len(embedding) > 0 and list_aggregate(list_transform(embedding, lambda c: c is not null and isfinite(c)), 'bool_and')),
    u as (select vec_id, x, sqrt(list_dot_product(x, x)) as size from v where list_dot_product(x, x) > 0),
    p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95),
    reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, p.b from reach r join p on r.b = p.a),
    c as (select a as vec_id, min(b) as component_id from reach group by 1),
    k as (select a as vec_id, count(*) as n from p group by 1)
    select c.vec_id, coalesce(n, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join k on c.vec_id = k.vec_id"""


@query
def op13_angular_filter(spark: SparkSession, folder: str) -> DataFrame:
    from tabflow.llm.negatives import hard_negatives

    rows = table(spark, folder, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL["op13_angular_filter"] = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
        from embeddings where label is not null and len(embedding) > 0 and list_aggregate(list_transform(embedding, lambda c: c is not null and isfinite(c)), 'bool_and')),
    s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
    n as (select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
        from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score)
    select * from n where rank <= 5"""

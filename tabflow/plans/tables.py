"""Queries: sources, projection, filters, set operations, positions, splits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.arrays import argmax
from tabflow.functions.maths import ratio_squared
from tabflow.functions.text import after_comma_word
from tabflow.operators import clean, rows, stats
from tabflow.operators.models import load_model, save_model
from tabflow.plans.registry import R, Tables, query, rounded
from tabflow.session import attach, fresh_path
from tabflow.sources import tables as io

# Rare titles read as Miss, and the titles that are kept.
RARE_MISS = ["Lady", "Mme", "Ms", "the Countess", "Mlle"]
KEPT_TITLES = ["Mr", "Mrs", "Miss", "Master"]


def collapse_titles(title):
    """Rare female titles become Miss, every other title outside the kept ones Other."""
    one = F.when(title.isin(RARE_MISS), F.lit("Miss")).otherwise(title)
    return F.when(one.isin(KEPT_TITLES), one).otherwise(F.lit("Other"))


# --- sources and sinks ---


@query("scan_csv_header", "select * from customer")
def scan_csv_header(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    io.write_csv(t.customer, path)
    return io.read_csv(t.spark, path, t.customer.schema, exact=True)


@query("csv_round_trip", "select * from documents union all select -doc_id, case when doc_id % 2 = 0 then '' end, null, concat(' \\N\\n\\', chr(10), chr(13), '\"', source, ' '), n_chars from documents")
def csv_round_trip(t: Tables) -> DataFrame:
    """Texts with line breaks, quotes, blanks and backslashes, empty texts and NULLs, written and read back."""
    path = fresh_path(t.spark, "csv")
    text = F.when(F.col("doc_id") % 2 == 0, "")
    odd = F.concat(F.lit(' \\N\\n\\\n\r"'), "source", F.lit(" "))
    more = t.documents.select((-F.col("doc_id")).alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("lang"), odd.alias("source"), "n_chars")
    io.write_csv(t.documents.unionByName(more), path)
    return io.read_csv(t.spark, path, t.documents.schema, exact=True)


@query("scan_csv_inferred", "select cast(p_partkey as integer) as p_partkey, p_name, p_brand, cast(p_size as integer) as p_size, p_retailprice from part")
def scan_csv_inferred(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    io.write_csv(t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return io.read_csv(t.spark, path, exact=True)


@query("scan_csv_named", "select s_suppkey as id, s_name as name, s_nationkey as nation, s_acctbal as balance from supplier")
def scan_csv_named(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    t.supplier.write.csv(path)
    return io.read_csv(t.spark, path, "id long, name string, nation int, balance double", names=False)


@query(
    "scan_incremental_append",
    f"""select l_orderkey, count(*) as n, {R('avg(l_quantity)')} as mean, {R('median(l_quantity)')} as median,
    max(l_quantity) as top, min(l_quantity) as low, {R('stddev_samp(l_quantity)')} as std from lineitem group by 1""",
)
def scan_incremental_append(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "chunks")
    columns = t.lineitem.select("l_orderkey", "l_linestatus", "l_quantity")
    # Two appends; orders with lines of both kinds are spread over both.
    io.write_csv(columns.filter(F.col("l_linestatus") == "O"), path, append=True)
    io.write_csv(columns.filter(F.col("l_linestatus") != "O"), path, append=True)
    q = F.col("l_quantity")
    out = io.read_csv(t.spark, path, columns.schema, exact=True).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean"), F.percentile(q, 0.5).alias("median"),
        F.max(q).alias("top"), F.min(q).alias("low"), F.stddev_samp(q).alias("std"),
    )
    return rounded(out)


@query("matrix_unpack", "select vec_id, embedding[1] as x1, embedding[2] as x2, label as y from embeddings")
def matrix_unpack(t: Tables) -> DataFrame:
    return io.matrix_unpack(t.embeddings.withColumnRenamed("label", "y"), "embedding", ["x1", "x2"], ["vec_id", "y"])


@query(
    "array_store",
    "select vec_id, label, unnest(embedding) as value, cast(generate_subscripts(embedding, 1) - 1 as integer) as pos from embeddings",
)
def array_store(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "arrays")
    io.write_arrays(t.embeddings, path)
    return io.read_arrays(t.spark, path).select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))


def _uniform(key: str, seed: str) -> str:
    return f"((('0x' || substr(md5(concat(cast({key} as varchar), '{seed}')), 1, 13))::bigint + 0.5) / 4503599627370496)"


def _normal(key: str, seed: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(key, seed + 'r')})) * cos(2 * pi() * {_uniform(key, seed + 'a')}))"


@query(
    "gen_blobs",
    f"""select image_id, i.label, {R('c1 + 0.5 * ' + _normal('image_id', '80'))} as x1, {R('c2 + 0.5 * ' + _normal('image_id', '81'))} as x2
    from image i join (select label, avg(pixels[1]) as c1, avg(pixels[2]) as c2 from image group by 1) c on i.label = c.label""",
)
def gen_blobs(t: Tables) -> DataFrame:
    centres = t.image.groupBy("label").agg(F.avg(F.col("pixels")[0]).alias("c1"), F.avg(F.col("pixels")[1]).alias("c2"))
    placed = attach(t.image.select("image_id", "label"), centres, ["label"])
    return rounded(io.gen_blobs(placed, "image_id", ["c1", "c2"], 0.5, 8).drop("c1", "c2"))


@query("sink_csv", "select * from orders")
def sink_csv(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "sink")
    io.write_csv(t.orders.filter(F.col("o_orderstatus") == "F"), path)
    io.write_csv(t.orders.filter(F.col("o_orderstatus") != "F"), path, append=True)
    return io.read_csv(t.spark, path, t.orders.schema, exact=True)


@query("submission_table", "select vec_id as image_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as label from embeddings")
def submission_table(t: Tables) -> DataFrame:
    scored = t.embeddings.withColumn("best", argmax(F.col("embedding")))
    return io.submission(scored, "vec_id", "best", ("image_id", "label"))


@query("model_store", f"select id, {R('regr_slope(y, x) over () * x + regr_intercept(y, x) over ()')} as prediction from regression_xy")
def model_store(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "model")
    stages = [VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y", solver="normal")]
    save_model(Pipeline(stages=stages).fit(t.regression_xy), path)
    return rounded(load_model(path).transform(t.regression_xy).select("id", "prediction"))


_GAPS = """select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderstatus end as o_orderstatus,
    case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_orderpriority from orders"""


def orders_with_gaps(t: Tables) -> DataFrame:
    """Orders where a share of cells is missing."""
    return t.spark.sql(_GAPS.replace("from orders", "from {orders}"), orders=t.orders)


@query(
    "profile_table",
    "\nunion all ".join(
        f"select '{c}' as \"column\", '{k}' as dtype, count(*) as n_rows, count({c}) as n_filled from ({_GAPS})"
        for c, k in [("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")]
    ),
)
def profile_table(t: Tables) -> DataFrame:
    return stats.profile(orders_with_gaps(t))


# --- projection and predicates ---


@query("select_columns", "select l_orderkey, l_quantity, l_extendedprice from lineitem")
def select_columns(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")


@query("drop_columns", "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders")
def drop_columns(t: Tables) -> DataFrame:
    return t.orders.drop("o_orderstatus", "o_orderdate")


@query(
    "derive_ratio_sq",
    f"""select obs_id, {R('pow(flux / flux_err, 2)')} as flux_ratio_sq, {R('flux * pow(flux / flux_err, 2)')} as flux_by_flux_ratio_sq,
    {R('coalesce(pow(flux / nullif(flux_err - 0.5, 0), 2), 0)')} as filled from light_curve_obs""",
)
def derive_ratio_sq(t: Tables) -> DataFrame:
    ratio = ratio_squared(F.col("flux"), F.col("flux_err"))
    filled = ratio_squared(F.col("flux"), F.col("flux_err") - 0.5, 0.0)
    return rounded(
        t.light_curve_obs.select("obs_id", ratio.alias("flux_ratio_sq"), (F.col("flux") * ratio).alias("flux_by_flux_ratio_sq"), filled.alias("filled"))
    )


@query("derive_product", f"select object_id, {R('hostgal_photoz * hostgal_photoz_err')} as hostgal_ph from object_meta")
def derive_product(t: Tables) -> DataFrame:
    return rounded(t.object_meta.select("object_id", (F.col("hostgal_photoz") * F.col("hostgal_photoz_err")).alias("hostgal_ph")))


@query(
    "derive_sum_flag",
    "select passenger_id, sibsp + parch as family_count, case when sibsp = 0 and parch = 0 then 1 else 0 end as alone from passenger",
)
def derive_sum_flag(t: Tables) -> DataFrame:
    alone = ((F.col("sibsp") == 0) & (F.col("parch") == 0)).cast("int")
    return t.passenger.select("passenger_id", (F.col("sibsp") + F.col("parch")).alias("family_count"), alone.alias("alone"))


@query(
    "conditional_assign",
    """select o_orderkey, case when o_orderpriority = '1-URGENT' then 3 when o_totalprice > 250000 then 2
    when o_orderstatus = 'F' then 1 else 0 end as grade from orders""",
)
def conditional_assign(t: Tables) -> DataFrame:
    rules = [
        (F.col("o_orderstatus") == "F", F.lit(1)),
        (F.col("o_totalprice") > 250000, F.lit(2)),
        (F.col("o_orderpriority") == "1-URGENT", F.lit(3)),
    ]
    return t.orders.select("o_orderkey", clean.assign_where(F.lit(0), rules).alias("grade"))


_TITLE = "split_part(split_part(name, ', ', 2), '.', 1)"
_COLLAPSED = f"""case when {_TITLE} in ('Lady', 'Mme', 'Ms', 'the Countess', 'Mlle') then 'Miss'
    when {_TITLE} in ('Mr', 'Mrs', 'Miss', 'Master') then {_TITLE} else 'Other' end"""


@query("collapse_rare", f"select passenger_id, {_COLLAPSED} as title from passenger")
def collapse_rare(t: Tables) -> DataFrame:
    return t.passenger.select("passenger_id", collapse_titles(after_comma_word(F.col("name"))).alias("title"))


@query("filter_eq", "select event_id, user_id, value from events where event_type = 'click'")
def filter_eq(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "click").select("event_id", "user_id", "value")


@query("filter_notnull", "select * from passenger where embarked is not null")
def filter_notnull(t: Tables) -> DataFrame:
    return t.passenger.na.drop(subset=["embarked"])


@query("filter_isin", "select event_id, event_type from events where event_type in ('click', 'view')")
def filter_isin(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("select_by_dtype", "select p_name, p_brand, p_type from part")
def select_by_dtype(t: Tables) -> DataFrame:
    return t.part.select(*clean.columns_of_type(t.part, "string"))


@query("select_by_stat", "select id, sale_price * 2 as list_price from house")
def select_by_stat(t: Tables) -> DataFrame:
    data = t.house.withColumn("list_price", F.col("sale_price") * 2)
    names = ["lot_frontage", "list_price"]
    found = stats.mutual_info(data, names, "sale_price", 5, 5).collect()
    return data.select("id", *clean.columns_above({m["column"]: m["mi"] for m in found}, 0.1))


@query("drop_allzero_columns", "select l_orderkey, l_quantity, l_tax from lineitem")
def drop_allzero_columns(t: Tables) -> DataFrame:
    data = t.lineitem.select("l_orderkey", "l_quantity", "l_tax", (F.col("l_quantity") * 0).alias("nothing"))
    return clean.drop_allzero(data, ["l_quantity", "l_tax", "nothing"])


@query("drop_low_cardinality", "select l_orderkey, l_extendedprice from lineitem")
def drop_low_cardinality(t: Tables) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return clean.drop_low_cardinality(t.lineitem.select("l_orderkey", *names), names)


@query("align_columns", "select o_totalprice, o_orderkey, o_orderpriority from orders")
def align_columns(t: Tables) -> DataFrame:
    like = t.orders.select("o_totalprice", "o_orderkey", "o_orderpriority")
    return clean.align_columns(t.orders, like)


@query("add_constant", "select 1 as ones, 0.0::double as zeros, c_custkey, c_acctbal from customer")
def add_constant(t: Tables) -> DataFrame:
    return t.customer.select(F.lit(1).alias("ones"), F.lit(0.0).alias("zeros"), "c_custkey", "c_acctbal")


@query("rename_columns", "select s_suppkey as id, s_name as label, s_nationkey as place, s_acctbal as balance from supplier")
def rename_columns(t: Tables) -> DataFrame:
    return t.supplier.toDF("id", "label", "place", "balance")


# --- set operations and lookups by id ---


@query(
    "union_by_name",
    """select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
    union all select s_suppkey, s_name, s_acctbal, null from supplier""",
)
def union_by_name(t: Tables) -> DataFrame:
    return _both(t)


def _both(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "split_back",
    """select 'train' as part, c_custkey as id, c_name as name, c_acctbal as balance from customer
    union all select 'test', s_suppkey, s_name, s_acctbal from supplier""",
)
def split_back(t: Tables) -> DataFrame:
    everything = _both(t).drop("segment")
    test_ids = t.supplier.select(F.col("s_name").alias("name"))
    test = clean.keep_ids(everything, test_ids, "name").withColumn("part", F.lit("test"))
    train = clean.drop_ids(everything, test_ids, "name").withColumn("part", F.lit("train"))
    return train.unionByName(test)


@query("semi_join_ids", "select * from customer where c_custkey in (select o_custkey from orders)")
def semi_join_ids(t: Tables) -> DataFrame:
    buyers = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return clean.keep_ids(t.customer, buyers, "c_custkey")


@query("anti_join_ids", "select * from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def anti_join_ids(t: Tables) -> DataFrame:
    dear = t.orders.filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return clean.drop_ids(t.customer, dear, "c_custkey")


# --- positions, folds and splits ---


@query("row_index", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as idx from orders")
def row_index(t: Tables) -> DataFrame:
    return rows.row_index(t.orders.select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], start=1).select("o_orderkey", "idx")


@query(
    "tumbling_rows",
    """select event_id, user_id, idx // 5 + 1 as window_id from (select event_id, user_id,
    row_number() over (partition by user_id order by ts, event_id) - 1 as idx, count(*) over (partition by user_id) as n from events)
    where idx < n // 5 * 5""",
)
def tumbling_rows(t: Tables) -> DataFrame:
    return rows.tumbling(t.events, ["ts", "event_id"], 5, ["user_id"]).select("event_id", "user_id", "window_id")


@query(
    "slice_head_tail",
    """select o_orderkey, case when row_number() over (order by o_orderkey) > (select count(*) from orders) - 3 then 'test' else 'train' end as part
    from orders""",
)
def slice_head_tail(t: Tables) -> DataFrame:
    head, tail = rows.head_tail(t.orders.select("o_orderkey"), ["o_orderkey"], 3)
    return head.withColumn("part", F.lit("train")).unionByName(tail.withColumn("part", F.lit("test")))


@query(
    "split_position_inclusive",
    """with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, (select count(*) // 2 from orders) as m from orders)
    select o_orderkey, 'train' as part from p where i <= m union all select o_orderkey, 'validation' from p where i >= m""",
)
def split_position_inclusive(t: Tables) -> DataFrame:
    keys = t.orders.select("o_orderkey")
    first, second = rows.split_at(keys, ["o_orderkey"], keys.count() // 2)
    return first.withColumn("part", F.lit("train")).unionByName(second.withColumn("part", F.lit("validation")))


@query(
    "kfold_contiguous",
    """with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, (select count(*) from orders) as n from orders)
    select o_orderkey, cast(case when i < (n % 7) * (n // 7 + 1) then i // (n // 7 + 1)
    else n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) end as integer) as fold from p""",
)
def kfold_contiguous(t: Tables) -> DataFrame:
    return rows.contiguous_folds(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


@query(
    "kfold_stratified",
    """select vec_id, label, cast((row_number() over (partition by label order by md5(concat(cast(vec_id as varchar), '157')), vec_id) - 1) % 8 as integer)
    as fold from embeddings""",
)
def kfold_stratified(t: Tables) -> DataFrame:
    return rows.stratified_folds(t.embeddings.select("vec_id", "label"), "vec_id", "label", 8)


@query(
    "split_random",
    """select o_orderkey, case when row_number() over (order by md5(concat(cast(o_orderkey as varchar), '157')))
    <= ceil(0.1 * (select count(*) from orders)) then 1 else 0 end as is_test from orders""",
)
def split_random(t: Tables) -> DataFrame:
    return rows.split_random(t.orders.select("o_orderkey"), "o_orderkey", 0.1)


@query(
    "split_stratified",
    """select vec_id, label, case when row_number() over (partition by label order by md5(concat(cast(vec_id as varchar), '157')))
    <= ceil(0.2 * count(*) over (partition by label)) then 1 else 0 end as is_test from embeddings""",
)
def split_stratified(t: Tables) -> DataFrame:
    return rows.split_stratified(t.embeddings.select("vec_id", "label"), "vec_id", "label", 0.2)


@query("head_n", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 5")
def head_n(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("argmax_vector", "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as best from embeddings")
def argmax_vector(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", argmax(F.col("embedding")).alias("best"))

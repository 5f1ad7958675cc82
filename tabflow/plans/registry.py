"""Named queries over the given tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# View name -> (source table, select list). ``<..>`` marks the few spellings that differ.
VIEWS = {
    "light_curve_obs": (
        "events",
        "event_id as obs_id, user_id as object_id, event_type as passband, cast(<us> as double) / 86400000000 as mjd, "
        "value as flux, cast(0.5 + event_id % 7 as double) as flux_err, case when value > 20 then 1 else 0 end as detected",
    ),
    "object_meta": (
        "customer",
        "c_custkey as object_id, c_acctbal as hostgal_photoz, cast(1 + c_custkey % 5 as double) as hostgal_photoz_err, "
        "c_custkey % 2 as ddf, c_mktsegment as target",
    ),
    "sensor_row": (
        "lineitem",
        "l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber as row_key, <ship> as datetime, "
        "l_quantity as s1, l_extendedprice as s2, l_discount as s3, l_tax as s4, case when l_returnflag = 'R' then 1 else 0 end as att_flag",
    ),
    "passenger": (
        "customer",
        "c_custkey as passenger_id, concat('N', cast(c_nationkey as <str>), ', ', case c_custkey % 6 when 0 then 'Mr' when 1 then 'Mrs' "
        "when 2 then 'Miss' when 3 then 'Master' when 4 then 'Dr' else 'Mme' end, '. ', c_name) as name, "
        "case when c_custkey % 7 = 0 then null else cast(c_custkey * 37 % 71 + 1 as double) end as age, c_custkey % 3 as sibsp, "
        "c_custkey % 2 as parch, case when c_custkey % 97 = 0 then null else c_acctbal end as fare, "
        "case when c_custkey % 50 = 0 then null else c_mktsegment end as embarked, case when c_custkey % 3 = 0 then 1 else 0 end as survived",
    ),
    "house": (
        "part",
        "p_partkey as id, case when p_partkey % 5 = 0 then null else cast(p_size as double) end as lot_frontage, "
        "case when p_partkey % 3 = 0 then null else p_type end as alley, case when p_partkey % 11 = 0 then null else p_brand end as sale_type, "
        "p_retailprice as sale_price",
    ),
    "money_text": ("orders", "o_orderkey as id, concat('$', <money>, ' ') as price, <money> as riders"),
    "image": ("embeddings", "vec_id as image_id, label, cast(embedding as <darr>) as pixels"),
    "scored_multi": (
        "embeddings",
        "vec_id as id, label as y_true, (label + case when vec_id % 4 = 0 then 1 else 0 end) % 10 as y_pred, "
        "cast(1 + vec_id % 9 as double) / 10 as p_true",
    ),
    "scored_binary": (
        "labelled",
        "doc_id as id, quality as y_true, case when cast(n_chars % 1000 as double) / 1000 > 0.3 then 1 else 0 end as y_pred, "
        "cast(n_chars % 1000 as double) / 1000 as p",
    ),
    "grid_scores": (
        "orders",
        "cast(floor(cast(o_orderkey as double) / 10) as bigint) as config_id, o_orderkey % 10 as split_id, "
        "cast(o_custkey % 100 as double) / 100 as score",
    ),
    "regression_xy": ("orders", "o_orderkey as id, cast(o_custkey as double) / 1000 as x, o_totalprice / 100000 as y"),
    "spike": (
        "events",
        "user_id as series_id, event_type as kind, cast(<us> as double) / 3600000000 as t_hours",
    ),
}
_DUCK = {
    "us": "epoch_us(ts)",
    "ship": "strftime(l_shipdate, '%d/%m/%y %H')",
    "str": "varchar",
    "money": "format('{:,}', cast(floor(o_totalprice) as bigint))",
    "darr": "double[]",
}
_SPARK = {
    "us": "unix_micros(cast(ts as timestamp))",
    "ship": "date_format(l_shipdate, 'dd/MM/yy HH')",
    "str": "string",
    "money": "format_number(cast(floor(o_totalprice) as bigint), 0)",
    "darr": "array<double>",
}
_JOINED = {"labelled": "(select l.doc_id, l.quality, d.n_chars from labels l join documents d on l.doc_id = d.doc_id)"}


def _spell(text: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        text = text.replace(f"<{k}>", v)
    return text


class Tables:
    """The tables of one folder, and the views above."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self._view(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        source, columns = VIEWS[name]
        if source == "labelled":
            rows = self.labels.join(self.documents.select("doc_id", "n_chars"), "doc_id")
        else:
            rows = getattr(self, source)
        return self.spark.sql(f"select {_spell(columns, _SPARK).replace('{', '{{').replace('}', '}}')} from {{rows}}", rows=rows)


def sql_with_views(sql: str) -> str:
    """Prefix the views a statement mentions."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    views = []
    for v in used:
        source, columns = VIEWS[v]
        views.append(f"{v} as (select {_spell(columns, _DUCK)} from {_JOINED.get(source, source)})")
    return f"with {', '.join(views)} select * from ({sql})"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql_with_views(sql)
        return fn

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded half away from zero for comparison across engines; the addition turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    unit = F.lit(float(10**digits))
    return F.signum(c) * F.floor(F.abs(c) * unit + F.lit(0.5)) / unit + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[r(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def R(expr: str, digits: int = 6) -> str:
    """SQL spelling of :func:`r`."""
    return f"(round({expr}, {digits}) + 0.0)"

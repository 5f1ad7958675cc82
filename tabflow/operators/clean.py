"""Column choice, missing values and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.hashing import integer_jitter, normal
from tabflow.operators.quantiles import exact_quantiles
from tabflow.session import attach


def nan_to_null(df: DataFrame) -> DataFrame:
    """Loader boundary: NaN becomes NULL so that aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def assign_where(start: Column, rules: Sequence[tuple[Column, Column]]) -> Column:
    """Ordered conditional writes: a later matching rule overrides an earlier one."""
    out = start
    for mask, value in rules:
        out = F.when(mask, value).otherwise(out)
    return out


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    return [name for name, t in df.dtypes if t == kind]


def align_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order."""
    return df.select(*like.columns)


def columns_above(stats: dict[str, float | None], cut: float) -> list[str]:
    """Names whose statistic is above ``cut``."""
    return [c for c, v in stats.items() if v is not None and v > cut]


def drop_allzero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the columns of ``cols`` that hold nothing but zero."""
    seen = df.agg(*[F.max((F.col(c) != 0).cast("int")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not seen[c]])


def drop_low_cardinality(df: DataFrame, cols: Sequence[str], fewest: int = 100) -> DataFrame:
    """Drop the columns of ``cols`` with fewer than ``fewest`` distinct values.

    A sketch settles the clear cases in one pass. A column near the cut is counted exactly; its
    distinct set is then known to be small.
    """
    about = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    low = [c for c in cols if about[c] < 0.5 * fewest]
    unsure = [c for c in cols if 0.5 * fewest <= about[c] <= 2 * fewest]
    if unsure:
        exact = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in unsure]).first()
        low += [c for c in unsure if exact[c] < fewest]
    return df.drop(*low)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``; the ids are made distinct before they meet the rows."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of every value that is not NULL."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value per column, ties to the smallest: ``(column, value, n)``.

    All columns are counted in one pass; the shuffle carries partial counts only. Values come
    back as text, numbers still tie by size.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
            (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("size"),
        )
        for c in cols
    ]
    pairs = df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").na.drop(subset=["value"])
    counts = pairs.groupBy("column", "value", "size").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), "size", "value", "n")).alias("b")
    return counts.groupBy("column").agg(best).select("column", "b.value", "b.n")


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs with the most frequent value of the column."""
    found = {r["column"]: r["value"] for r in modes(df, cols).collect()}
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(c, F.lit(found[c]).cast(kinds[c])) for c in cols if c in found})


def group_mean(df: DataFrame, key: str, value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(name))


def lookup_group_mean(df: DataFrame, key: str, value: str, name: str = "group_mean") -> DataFrame:
    """Each row with the mean of its group."""
    return attach(df, group_mean(df, key, value, name), [key])


def impute_group_mean(
    df: DataFrame, row_key: str, group: str, value: str, jittered: Sequence[str] = (), seed: int = 157
) -> DataFrame:
    """Fill NULLs with the rounded-up group mean.

    Groups named in ``jittered`` get a whole number in [-6, 5] on top, drawn from the row key. A
    group without any known value stays NULL.
    """
    looked = lookup_group_mean(df, group, value, "__mean")
    fill = F.ceil("__mean").cast("double")
    if jittered:
        fill = fill + F.when(F.col(group).isin(list(jittered)), integer_jitter(row_key, seed)).otherwise(F.lit(0))
    return looked.withColumn(value, F.coalesce(value, fill)).select(*df.columns)


def impute_median_inf(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and NULL to the median, infinities to the largest and smallest finite value."""
    inf = float("inf")

    def finite(c):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(inf)), F.col(c))

    clean = df.select(*[finite(c).alias(c) for c in cols])
    spread = clean.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    medians = exact_quantiles(clean, cols, [0.5])

    def filled(c):
        return (
            F.when(F.col(c) == F.lit(inf), F.lit(spread[f"hi_{c}"]))
            .when(F.col(c) == F.lit(-inf), F.lit(spread[f"lo_{c}"]))
            .otherwise(F.coalesce(finite(c), F.lit(medians[c][0])))
        )

    return df.withColumns({c: filled(c) for c in cols})


def add_noise(df: DataFrame, key: str, names: Sequence[str], scale: float = 1e-4, seed: int = 157) -> DataFrame:
    """Replace (or add) columns with small normal noise drawn from the row key."""
    return df.withColumns({c: normal(key, f"{seed}{c}") * F.lit(scale) for c in names})

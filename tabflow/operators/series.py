"""Per-series statistics, row windows and the pairwise time-lag kernel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions.maths import ratio_squared
from tabflow.operators.quantiles import SMALL, group_median
from tabflow.operators.rows import _RANGE, RANGE_ROWS, row_index, with_ranges
from tabflow.session import cut_lineage

# Prefixes of the five per-band statistics, in column order.
STATS = ["mn", "md", "mx", "mi", "st"]
# Passband numbers 0..5 and their letters.
BAND_LETTERS = {0: "u", 1: "g", 2: "r", 3: "i", 4: "z", 5: "Y"}


def band_stats_long(df: DataFrame, key: str, band: str, value: str, extra: Sequence[Column] = (), hot_rows: int = SMALL) -> DataFrame:
    """Mean, median, max, min and sample deviation per (object, band), one scan.

    Everything but the median is pre-aggregated before the shuffle. The median takes the bracket
    way for groups above ``hot_rows`` rows.
    """
    plain = [
        F.avg(value).alias("mn"), F.max(value).alias("mx"), F.min(value).alias("mi"),
        F.stddev_samp(value).alias("st"), *extra,
    ]
    biggest = df.groupBy(key, band).count().agg(F.max("count")).first()[0] or 0
    if biggest <= hot_rows:
        return df.groupBy(key, band).agg(F.percentile(value, 0.5).alias("md"), *plain)
    return df.groupBy(key, band).agg(*plain).join(group_median(df, [key, band], value, "md", hot_rows), [key, band], "left")


def widen(long: DataFrame, key: str, band: str, bands: Sequence, stats: Sequence[str], letters: dict | None = None) -> DataFrame:
    """One row per object, one column ``{stat}_{band}`` per cell; a missing band gives NULL."""
    letters = letters or {}
    cells = [
        F.max(F.when(F.col(band) == F.lit(b), F.col(s))).alias(f"{s}_{letters.get(b, b)}") for s in stats for b in bands
    ]
    return long.groupBy(key).agg(*cells)


def detected_rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def flux_ratio_sums(value: str, error: str) -> tuple[Column, Column]:
    """Sums of ``(f/e)^2`` and ``f * (f/e)^2``."""
    r = ratio_squared(F.col(value), F.col(error))
    return F.sum(r), F.sum(F.col(value) * r)


def detected_span(df: DataFrame, key: str, t: str, flag: str, name: str = "mjd_diff") -> DataFrame:
    """Time between first and last detection; NULL for an object without any."""
    at = F.when(F.col(flag) == 1, F.col(t))
    return df.groupBy(key).agg((F.max(at) - F.min(at)).alias(name))


def light_curve(df: DataFrame, key: str, wanted, t: str, value: str, band: str, letters: dict) -> DataFrame:
    """Points of one object with the band spelled out; an unknown object is refused."""
    points = df.filter(F.col(key) == F.lit(wanted))
    if not points.limit(1).count():
        raise ValueError(f"no object {wanted!r} in column {key}")
    return points.select(t, value, lookup(F.col(band), letters).alias(band))


def lookup(c: Column, table: dict) -> Column:
    """Code to label through a fixed dictionary; unknown codes give NULL."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), c)


def window_features(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str) -> DataFrame:
    """Feature set of every window; a window is a group of a few rows named by ``keys``."""
    items = F.sort_array(F.collect_list(F.struct(*order_by, F.col(value).cast("double").alias("__v"))))
    x = F.col("__x")
    arrays = df.groupBy(*keys).agg(items.alias("__s")).select(*keys, F.transform("__s", lambda s: s["__v"]).alias("__x"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    n = F.size(x).cast("double")
    base = arrays.withColumn("__n", n).withColumn("__m", total(x) / n)
    base = base.withColumn("__d", F.transform(x, lambda v: v - F.col("__m")))
    steps = F.zip_with(F.slice(x, 2, F.size(x)), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a)
    base = base.withColumn("__step", steps).withColumn("__sorted", F.sort_array(x))
    n, m, d = F.col("__n"), F.col("__m"), F.col("__d")
    energy = total(F.transform(x, lambda v: v * v))
    spread = total(F.transform(d, lambda v: v * v))
    lagged = total(F.zip_with(F.slice(d, 2, F.size(d)), F.slice(d, 1, F.size(d) - 1), lambda b, a: a * b))
    time_mid = (n - 1) / 2
    slope_top = total(F.transform(d, lambda v, i: v * (i.cast("double") - time_mid)))
    slope_bottom = n * (n * n - 1) / 12
    slope = F.try_divide(slope_top, slope_bottom)
    low, high = F.array_min(x), F.array_max(x)
    back = F.reverse(x)

    def spot(a: Column, v: Column) -> Column:
        return (F.array_position(a, v) - 1).cast("double") / n

    half = F.floor((F.size(x) - 1) / 2).cast("int")
    upper = F.ceil((F.size(x) - 1) / 2).cast("int")
    feats = {
        "length": F.size(x).cast("long"),
        "sum_values": total(x),
        "mean": m,
        "median": (F.get("__sorted", half) + F.get("__sorted", upper)) / 2,
        "minimum": low,
        "maximum": high,
        "variance": spread / n,
        "standard_deviation": F.sqrt(spread / n),
        "root_mean_square": F.sqrt(energy / n),
        "abs_energy": energy,
        "absolute_sum_of_changes": total(F.transform("__step", lambda v: F.abs(v))),
        "mean_abs_change": F.try_divide(total(F.transform("__step", lambda v: F.abs(v))), n - 1),
        "mean_change": F.try_divide(F.get(x, F.size(x) - 1) - F.get(x, F.lit(0)), n - 1),
        "count_above_mean": F.size(F.filter(d, lambda v: v > 0)).cast("long"),
        "count_below_mean": F.size(F.filter(d, lambda v: v < 0)).cast("long"),
        "first_location_of_maximum": spot(x, high),
        "first_location_of_minimum": spot(x, low),
        "last_location_of_maximum": 1 - spot(back, high),
        "last_location_of_minimum": 1 - spot(back, low),
        "autocorrelation_lag_1": F.try_divide(lagged, (n - 1) * spread / n),
        "linear_trend_slope": slope,
        "linear_trend_intercept": m - slope * time_mid,
    }
    return base.select(*keys, *[c.alias(f) for f, c in feats.items()])


def spread_window_features(rows: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Window features on every row of the window."""
    return rows.join(features, list(keys))


def step_blocks(df: DataFrame, order_by: Sequence[str], value: str, size: int = 6, blocks: int | None = None, **kw) -> DataFrame:
    """The series cut in blocks of ``size`` steps: ``(block, time, value)``; optionally the first blocks only."""
    placed = row_index(df, order_by, "time", **kw)
    out = placed.select(F.floor(F.col("time") / F.lit(size)).cast("long").alias("block"), "time", value)
    return out if blocks is None else out.filter(F.col("block") < blocks)


def pair_lag_kernel(
    df: DataFrame, series: str, kind: str, t: str, inputs: str, outputs: str, tau: float = 10.0, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Sum over all (input, output) event pairs of a series of a signed exponential of their lag.

    With ``dt = t_in - t_out`` a pair adds ``exp(-dt/tau)`` for a positive lag and
    ``-exp(dt/tau)`` otherwise. The exponential factors into one term per event, so a running sum
    over the time-ordered events replaces the pairs: linear work, and no cut-off is needed.

    Running sums restart in every block of ``50 * tau`` time units, which keeps the factors in
    range; earlier blocks enter with their decay, up to the point where it underflows to zero.
    """
    reach = 50.0
    events = df.filter(F.col(kind).isin(inputs, outputs))
    times = events.groupBy(series, t).agg(
        F.sum((F.col(kind) == F.lit(inputs)).cast("double")).alias("__in"),
        F.sum((F.col(kind) == F.lit(outputs)).cast("double")).alias("__out"),
    )
    cut, _ = with_ranges(times, t, range_rows)
    cut = cut.withColumn("__block", F.floor(F.col(t) / F.lit(reach * tau)).cast("long"))
    offset = (F.col(t) - F.col("__block") * F.lit(reach * tau)) / F.lit(tau)
    cut = cut.withColumns({"__gin": F.col("__in") * F.exp(offset), "__gout": F.col("__out") * F.exp(offset), "__fall": F.exp(-offset)})

    parts = [series, _RANGE, "__block"]
    order = Window.partitionBy(*parts).orderBy(t)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("__o", F.coalesce(F.sum("__gout").over(before), F.lit(0.0))).withColumn("__i", F.sum("__gin").over(upto))

    # One row per series, range and block; both carries below start from the written rows.
    totals = cut_lineage(cut.groupBy(*parts).agg(F.sum("__gin").alias("__tin"), F.sum("__gout").alias("__tout")))
    same = Window.partitionBy(series, "__block").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *parts,
        F.coalesce(F.sum("__tin").over(same), F.lit(0.0)).alias("__cin"),
        F.coalesce(F.sum("__tout").over(same), F.lit(0.0)).alias("__cout"),
    )
    # exp(-750) is zero in double precision: 15 blocks back nothing is left.
    ahead = totals.select(series, "__block", "__tin", "__tout", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("__j"))
    faded = F.exp(F.lit(-reach) * F.col("__j"))
    older = ahead.groupBy(series, (F.col("__block") + F.col("__j")).alias("__block")).agg(
        F.sum(F.col("__tin") * faded).alias("__pin"), F.sum(F.col("__tout") * faded).alias("__pout")
    )
    carry = carry.join(older, [series, "__block"], "left")
    joined = rows.join(carry, parts)

    def with_carry(own: str, near: str, far: str) -> Column:
        return F.col(own) + F.col(near) + F.coalesce(far, F.lit(0.0))

    gain = F.col("__in") * F.col("__fall") * with_carry("__o", "__cout", "__pout")
    loss = F.col("__out") * F.col("__fall") * with_carry("__i", "__cin", "__pin")
    return joined.groupBy(series).agg(F.sum(gain - loss).alias("weight_change"))

"""Queries: aggregates, series features, metrics, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.arrays import mean_square_gap
from tabflow.operators import clean, metrics, models, neighbors, rows, series, stats, tune
from tabflow.operators.anomaly import fit_gaussian
from tabflow.plans.registry import R, Tables, query, r, rounded
from tabflow.session import attach, cut_lineage

BANDS = ["click", "error", "purchase", "signup", "view"]
_STAT_SQL = {
    "mn": "avg({v})", "md": "median({v})", "mx": "max({v})", "mi": "min({v})", "st": "stddev_samp({v})",
}
_SENSORS = ["s1", "s2", "s3", "s4"]

# --- per-series statistics ---


@query(
    "band_stats_wide",
    "select object_id, "
    + ", ".join(f"{R(e.format(v='flux') + f' filter (passband = {chr(39)}{b}{chr(39)})')} as {s}_{b}" for s, e in _STAT_SQL.items() for b in BANDS)
    + " from light_curve_obs group by 1",
)
def band_stats_wide(t: Tables) -> DataFrame:
    long = series.band_stats_long(t.light_curve_obs, "object_id", "passband", "flux")
    return rounded(series.widen(long, "object_id", "passband", BANDS, series.STATS))


@query(
    "band_stats_long",
    "select object_id, passband, " + ", ".join(f"{R(e.format(v='flux'))} as {s}" for s, e in _STAT_SQL.items()) + " from light_curve_obs group by 1, 2",
)
def band_stats_long(t: Tables) -> DataFrame:
    return rounded(series.band_stats_long(t.light_curve_obs, "object_id", "passband", "flux"))


@query(
    "band_detected_rate",
    "select object_id, " + ", ".join(f"{R(f'avg(detected) filter (passband = {chr(39)}{b}{chr(39)})')} as det_avg_{b}" for b in BANDS) + " from light_curve_obs group by 1",
)
def band_detected_rate(t: Tables) -> DataFrame:
    long = t.light_curve_obs.groupBy("object_id", "passband").agg(series.detected_rate("detected").alias("det_avg"))
    return rounded(series.widen(long, "object_id", "passband", BANDS, ["det_avg"]))


@query(
    "band_flux_ratio_sums",
    "select object_id, "
    + ", ".join(
        f"{R(f'sum({e}) filter (passband = {chr(39)}{b}{chr(39)}) / 1e6')} as {s}_{b}"
        for s, e in [("rtsq", "pow(flux / flux_err, 2)"), ("flrt", "flux * pow(flux / flux_err, 2)")]
        for b in BANDS
    )
    + " from light_curve_obs group by 1",
)
def band_flux_ratio_sums(t: Tables) -> DataFrame:
    rtsq, flrt = series.flux_ratio_sums("flux", "flux_err")
    long = t.light_curve_obs.groupBy("object_id", "passband").agg((rtsq / 1e6).alias("rtsq"), (flrt / 1e6).alias("flrt"))
    return rounded(series.widen(long, "object_id", "passband", BANDS, ["rtsq", "flrt"]))


@query("detected_span", f"select object_id, {R('max(mjd) filter (detected = 1) - min(mjd) filter (detected = 1)')} as mjd_diff from light_curve_obs group by 1")
def detected_span(t: Tables) -> DataFrame:
    return rounded(series.detected_span(t.light_curve_obs, "object_id", "mjd", "detected"))


_MOST_SEEN = "(select user_id from events group by 1 order by count(*) desc, 1 limit 1)"
# One letter per kind of event.
LETTERS = dict(zip(BANDS, ["u", "g", "r", "i", "z"], strict=True))
_LETTER_CASE = "case event_type " + " ".join(f"when '{b}' then '{v}'" for b, v in LETTERS.items()) + " end"


@query("light_curve", f"select {R('epoch_us(ts)::double / 86400000000', 9)} as mjd, value as flux, {_LETTER_CASE} as passband from events where user_id = {_MOST_SEEN}")
def light_curve(t: Tables) -> DataFrame:
    most = t.events.groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id").first()["user_id"]
    return rounded(series.light_curve(t.light_curve_obs, "object_id", most, "mjd", "flux", "passband", LETTERS), 9)


@query("dict_map", f"select event_id, {_LETTER_CASE} as letter from events")
def dict_map(t: Tables) -> DataFrame:
    return t.events.select("event_id", series.lookup(F.col("event_type"), LETTERS).alias("letter"))


_WINDOWED = """select *, idx // 5 + 1 as window_id, idx % 5 as p, lag(v) over (partition by user_id, idx // 5 order by idx) as prev,
    avg(v) over (partition by user_id, idx // 5) as m, max(v) over (partition by user_id, idx // 5) as hi, min(v) over (partition by user_id, idx // 5) as lo,
    lag(v) over (partition by user_id, idx // 5 order by idx) - avg(v) over (partition by user_id, idx // 5) as prev_d
    from (select user_id, event_id, value as v, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, count(*) over (partition by user_id) as n from events)
    where idx < n // 5 * 5"""
_FEATURES = {
    "length": "count(*)", "sum_values": "sum(v)", "mean": "avg(v)", "median": "median(v)", "minimum": "min(v)", "maximum": "max(v)",
    "variance": "var_pop(v)", "standard_deviation": "stddev_pop(v)", "root_mean_square": "sqrt(avg(v * v))", "abs_energy": "sum(v * v)",
    "absolute_sum_of_changes": "sum(abs(v - prev))", "mean_abs_change": "avg(abs(v - prev))", "mean_change": "avg(v - prev)",
    "count_above_mean": "count(*) filter (v > m)", "count_below_mean": "count(*) filter (v < m)",
    "first_location_of_maximum": "min(p) filter (v = hi) / 5", "first_location_of_minimum": "min(p) filter (v = lo) / 5",
    "last_location_of_maximum": "(max(p) filter (v = hi) + 1) / 5", "last_location_of_minimum": "(max(p) filter (v = lo) + 1) / 5",
    "autocorrelation_lag_1": "sum(prev_d * (v - m)) / nullif(4 * var_pop(v), 0)",
    "linear_trend_slope": "sum((v - m) * (p - 2)) / 10", "linear_trend_intercept": "avg(v) - sum((v - m) * (p - 2)) / 10 * 2",
}
_WHOLE = {"length", "count_above_mean", "count_below_mean"}


@query(
    "window_features",
    "select user_id, window_id, " + ", ".join(f"{e if f in _WHOLE else R(e)} as {f}" for f, e in _FEATURES.items()) + f" from ({_WINDOWED}) group by 1, 2",
)
def window_features(t: Tables) -> DataFrame:
    placed = rows.tumbling(t.events, ["ts", "event_id"], 5, ["user_id"])
    return rounded(series.window_features(placed, ["user_id", "window_id"], ["ts", "event_id"], "value"))


@query(
    "broadcast_window_features",
    f"""with w as ({_WINDOWED}), f as (select user_id, window_id, {', '.join(f"{e if n in _WHOLE else R(e)} as {n}" for n, e in _FEATURES.items())} from w group by 1, 2)
    select w.event_id, w.v as value, f.* from w join f on w.user_id = f.user_id and w.window_id = f.window_id""",
)
def broadcast_window_features(t: Tables) -> DataFrame:
    """All features of a window on each of its rows; the windows are laid out once."""
    placed = cut_lineage(rows.tumbling(t.events.select("event_id", "user_id", "ts", "value"), ["ts", "event_id"], 5, ["user_id"]))
    feats = rounded(series.window_features(placed, ["user_id", "window_id"], ["ts", "event_id"], "value"))
    return series.spread_window_features(placed.select("event_id", "user_id", "window_id", "value"), feats, ["user_id", "window_id"])


@query("label_series_window", "select idx // 6 as block, idx as time, value from (select value, row_number() over (order by event_id) - 1 as idx from events)")
def label_series_window(t: Tables) -> DataFrame:
    return series.step_blocks(t.events, ["event_id"], "value", 6)


@query(
    "pair_lag_kernel",
    f"""select s.series_id, {R('coalesce(sum(case when i.t_hours is null or o.t_hours is null then 0 when i.t_hours > o.t_hours then exp(-(i.t_hours - o.t_hours) / 10) else -exp((i.t_hours - o.t_hours) / 10) end), 0)')} as weight_change
    from (select distinct series_id from spike where kind in ('click', 'purchase')) s
    left join (select * from spike where kind = 'click') i on i.series_id = s.series_id
    left join (select * from spike where kind = 'purchase') o on o.series_id = s.series_id group by 1""",
)
def pair_lag_kernel(t: Tables) -> DataFrame:
    return rounded(series.pair_lag_kernel(t.spike, "series_id", "kind", "t_hours", "click", "purchase"))


# --- table statistics ---


@query(
    "concat_columns",
    f"select c_custkey, c_acctbal, n_orders, {R('total')} as total from customer join (select o_custkey, count(*) as n_orders, sum(o_totalprice) as total from orders group by 1) on o_custkey = c_custkey",
)
def concat_columns(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return t.customer.select("c_custkey", "c_acctbal").join(per, "c_custkey").withColumn("total", r("total"))


@query("group_mean", f"select p_type, {R('avg(p_retailprice)')} as mean from part group by 1")
def group_mean(t: Tables) -> DataFrame:
    return rounded(clean.group_mean(t.part, "p_type", "p_retailprice"))


@query("distinct_values", "select distinct event_type from events")
def distinct_values(t: Tables) -> DataFrame:
    return t.events.select("event_type").distinct()


@query("distinct_count", "select count(distinct l_partkey) as n_parts from lineitem")
def distinct_count(t: Tables) -> DataFrame:
    return stats.distinct_count(t.lineitem, "l_partkey", name="n_parts")


@query(
    "mode_value",
    "\nunion all ".join(
        f"(select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as n from orders group by {c} order by count(*) desc, {c} limit 1)"
        for c in ["o_orderstatus", "o_orderpriority", "o_custkey"]
    ),
)
def mode_value(t: Tables) -> DataFrame:
    return clean.modes(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("value_counts", "select o_orderpriority, count(*) as n from orders group by 1")
def value_counts(t: Tables) -> DataFrame:
    return clean.value_counts(t.orders, "o_orderpriority")


@query("class_counts", "select label, count(*) as n from embeddings group by 1")
def class_counts(t: Tables) -> DataFrame:
    return clean.value_counts(t.embeddings, "label")


@query("column_minmax", "\nunion all ".join(f"select '{c}' as \"column\", min({c}) as min, max({c}) as max from sensor_row" for c in _SENSORS))
def column_minmax(t: Tables) -> DataFrame:
    return stats.column_minmax(t.sensor_row, _SENSORS)


_PAIRS = [(a, b) for i, a in enumerate(_SENSORS) for b in _SENSORS[i:]]
_SCALED = "(select row_key, s1 / 10 as s1, s2 / 10000 as s2, s3 * 10 as s3, s4 * 10 as s4, att_flag from sensor_row)"


def scaled_sensors(t: Tables) -> DataFrame:
    """Sensor columns of similar size."""
    return t.sensor_row.select(
        "row_key", (F.col("s1") / 10).alias("s1"), (F.col("s2") / 10000).alias("s2"), (F.col("s3") * 10).alias("s3"),
        (F.col("s4") * 10).alias("s4"), "att_flag",
    )


@query(
    "mean_cov",
    "\nunion all ".join(
        f"select '{a}' as col_i, '{b}' as col_j, {R(f'avg({a})')} as mean_i, {R(f'avg({b})')} as mean_j, {R(f'covar_samp({a}, {b})')} as cov from {_SCALED}"
        for a, b in _PAIRS
    ),
)
def mean_cov(t: Tables) -> DataFrame:
    return rounded(stats.mean_cov(scaled_sensors(t), _SENSORS))


@query("corr_matrix", "\nunion all ".join(f"select '{a}' as col_i, '{b}' as col_j, {R(f'corr({a}, {b})')} as corr from sensor_row" for a, b in _PAIRS))
def corr_matrix(t: Tables) -> DataFrame:
    return rounded(stats.corr_matrix(t.sensor_row, _SENSORS))


@query(
    "histogram_by_class",
    "\nunion all ".join(
        f"""select '{c}' as "column", att_flag, cast(least(floor(({c} - lo) / (hi - lo) * 100), 99) as integer) as bin, count(*) as n
        from sensor_row, (select min({c}) as lo, max({c}) as hi from sensor_row) group by 1, 2, 3"""
        for c in _SENSORS
    ),
)
def histogram_by_class(t: Tables) -> DataFrame:
    return stats.histogram_by_class(t.sensor_row, _SENSORS, "att_flag", 100)


_MI = """select '{c}' as "column", sum(n / t * ln(n * t / (nx * ny))) as mi from (select n::double as n, sum(n) over ()::double as t,
    sum(n) over (partition by x)::double as nx, sum(n) over (partition by att_flag)::double as ny from (select att_flag,
    least(floor(({c} - lo) / (hi - lo) * 10), 9) as x, count(*) as n from sensor_row, (select min({c}) as lo, max({c}) as hi from sensor_row) group by 1, 2))"""


@query("mutual_info", f"select \"column\", {R('mi', 9)} as mi from (" + "\nunion all ".join(_MI.format(c=c) for c in _SENSORS) + ")")
def mutual_info(t: Tables) -> DataFrame:
    return rounded(stats.mutual_info(t.sensor_row, _SENSORS, "att_flag"), 9)


_MI_NEAR = """with v as (select image_id as id, label as y, unnest(pixels[1:4]) as x, concat('p', generate_subscripts(pixels[1:4], 1) - 1) as "column" from image),
    g as (select a."column", a.id, a.x, a.y, abs(a.x - b.x) as d, b.id as other, row_number() over (partition by a."column", a.id order by abs(a.x - b.x), b.id) as i, count(*) over (partition by a."column", a.id) as others
        from v a join v b on a."column" = b."column" and a.y = b.y and a.id <> b.id),
    r as (select "column", id, x, others + 1 as size, least(3, others) as k, d as radius from g where i = least(3, others)),
    m as (select r."column", r.id, any_value(size) as size, any_value(k) as k, count(*) as m from r join v on r."column" = v."column" and v.y in (select y from v group by y, "column" having count(*) > 1)
        and (abs(v.x - r.x) < radius or v.x = r.x) group by 1, 2),
    h as (select i as n, sum(case when i > 1 then 1.0::double / (i - 1) else 0 end) over (order by i) - 0.5772156649015329 as psi from range(1, 200000) t(i))
    select m."column", greatest(0, any_value(t.psi) + avg(a.psi - b.psi - c.psi)) as mi from m join (select "column", count(*) as n from m group by 1) s on m."column" = s."column"
    join h t on t.n = s.n join h a on a.n = m.k join h b on b.n = m.size join h c on c.n = m.m group by 1"""


@query("mutual_info_neighbors", f"select \"column\", {R('mi', 6)} as mi from ({_MI_NEAR})")
def mutual_info_neighbors(t: Tables) -> DataFrame:
    """By the third neighbour of the same label, for the first four entries of every vector."""
    data = t.image.select("label", *[F.col("pixels")[i].alias(f"p{i}") for i in range(4)])
    return rounded(stats.mutual_info_neighbors(data, [f"p{i}" for i in range(4)], "label"), 6)


@query("select_percentile", "select id, list_price, parch_like from (select id, sale_price * 2 as list_price, floor(sale_price / 10) as parch_like from house)")
def select_percentile(t: Tables) -> DataFrame:
    data = t.house.select(
        "id", F.coalesce("lot_frontage", F.lit(0.0)).alias("frontage"), (F.col("id") % 2).alias("odd"), (F.col("id") % 3).alias("third"),
        (F.col("sale_price") * 2).alias("list_price"), F.floor(F.col("sale_price") / 10).cast("double").alias("parch_like"), "sale_price",
    )
    kept = stats.top_percent(stats.mutual_info(data, ["frontage", "odd", "third", "list_price", "parch_like"], "sale_price", 10, 10), "mi", 40)
    return data.select("id", *sorted(kept))


@query(
    "row_mse",
    f"""with u as (select image_id, label, unnest(pixels) as v, generate_subscripts(pixels, 1) as pos from image)
    select image_id, {R('avg((v - m) * (v - m))')} as mse from u join (select label, pos, avg(v) as m from u group by 1, 2) c on c.label = u.label and c.pos = u.pos group by 1""",
)
def row_mse(t: Tables) -> DataFrame:
    cells = t.image.select("label", F.posexplode("pixels").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("m"))
    # One array entry per vector position.
    means = cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    return rounded(attach(t.image, means, ["label"]).select("image_id", mean_square_gap(F.col("pixels"), F.col("mean")).alias("mse")))


_THETA = [0.1, -0.2, 0.3, 0.05]
_Z = "(0.1 * ones - 0.2 * s1 + 0.3 * s3 + 0.05 * s4)"
_P = f"(1 / (1 + exp(-{_Z})))"


def _with_ones(t: Tables) -> DataFrame:
    return scaled_sensors(t).withColumn("ones", F.lit(1.0))


@query(
    "logistic_cost",
    f"""select {R(f"avg(-att_flag * ln({_P}) - (1 - att_flag) * ln(1 - {_P})) + (0.2 * 0.2 + 0.3 * 0.3 + 0.05 * 0.05) / 2 / count(*)", 9)} as cost
    from (select *, 1.0::double as ones from {_SCALED})""",
)
def logistic_cost(t: Tables) -> DataFrame:
    return rounded(models.logistic_cost(_with_ones(t), ["ones", "s1", "s3", "s4"], "att_flag", _THETA, 1.0), 9)


@query(
    "logistic_gradient",
    "\nunion all ".join(
        f"select cast({i} as integer) as position, {R(f'avg(({_P} - att_flag) * {c}) + {_THETA[i] if i else 0} / count(*)', 9)} as gradient from (select *, 1.0::double as ones from {_SCALED})"
        for i, c in enumerate(["ones", "s1", "s3", "s4"])
    ),
)
def logistic_gradient(t: Tables) -> DataFrame:
    return rounded(models.logistic_gradient(_with_ones(t), ["ones", "s1", "s3", "s4"], "att_flag", _THETA, 1.0), 9)


@query(
    "grid_cross",
    f"""select {R('lo1 + (hi1 - lo1) * i / 29')} as x1, {R('lo2 + (hi2 - lo2) * j / 29')} as x2 from (select min(s1) as lo1, max(s1) as hi1,
    min(s2) as lo2, max(s2) as hi2 from sensor_row), range(30) a(i), range(30) b(j)""",
)
def grid_cross(t: Tables) -> DataFrame:
    return rounded(even_grid(t.sensor_row, "s1", "s2").select(F.col("s1").alias("x1"), F.col("s2").alias("x2")))


def even_grid(data: DataFrame, a: str, b: str, points: int = 30) -> DataFrame:
    """Evenly spaced grid over the range of two columns, ``points`` x ``points`` rows."""
    lo_a, hi_a, lo_b, hi_b = data.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    cell = data.sparkSession.range(points * points)
    i, j = F.floor(F.col("id") / F.lit(points)), F.col("id") % points
    last = points - 1
    return cell.select((F.lit(lo_a) + F.lit(hi_a - lo_a) * i / last).alias(a), (F.lit(lo_b) + F.lit(hi_b - lo_b) * j / last).alias(b))


# --- neighbours ---

_KNN = """select a.image_id as query_id, b.image_id as neighbor_id, {d} as distance, row_number() over (partition by a.image_id order by {d}, b.image_id) as rank
    from image a join image b on a.image_id <> b.image_id"""
_L2 = "list_distance(a.pixels, b.pixels)"
_NEAR = f"(select * from ({_KNN.format(d=_L2)}) where rank <= 5)"


@query("knn_exact", f"select query_id, neighbor_id, {R('distance')} as distance, cast(rank as integer) as rank from {_NEAR}")
def knn_exact(t: Tables) -> DataFrame:
    return rounded(neighbors.knn(t.image, t.image, "image_id", "pixels", 5, exclude_self=True))


@query(
    "knn_classify",
    f"""select query_id, label as prediction from (select query_id, label, row_number() over (partition by query_id order by sum(1 / distance) desc, label) as r
    from {_NEAR} n join image on image_id = neighbor_id group by 1, 2) where r = 1""",
)
def knn_classify(t: Tables) -> DataFrame:
    near = neighbors.knn(t.image, t.image, "image_id", "pixels", 5, exclude_self=True)
    return neighbors.classify(near, t.image, "image_id", "label", "distance")


@query("knn_approx", "select count(*) as n_queries, cast(5 * count(*) as bigint) as n_found, true as recall_holds from image")
def knn_approx(t: Tables) -> DataFrame:
    """Neighbours among vectors of ten directions: five for every row, at least nine in ten of them among the true five."""
    # Vectors near one of ten directions, by their label, so that there are neighbours to speak of.
    near = F.transform("pixels", lambda v, i: v / 4 + F.when(i % 10 == F.col("label"), F.lit(0.5)).otherwise(F.lit(0.0)))
    data = cut_lineage(t.image.select("image_id", near.alias("pixels")))
    found = cut_lineage(neighbors.knn_approx(data, data, "image_id", "pixels", 5, exclude_self=True))
    true = neighbors.knn(data, data, "image_id", "pixels", 5, exclude_self=True)
    hits = found.join(true.select("query_id", "neighbor_id"), ["query_id", "neighbor_id"], "left_semi").count()
    return found.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_found"), (F.lit(hits) >= 0.9 * F.count(F.lit(1))).alias("recall_holds"))


# --- metrics ---


@query(
    "confusion_matrix",
    "select cast(a as integer) as y_true, cast(b as integer) as y_pred, (select count(*) from scored_multi where y_true = a and y_pred = b) as n from range(10) x(a), range(10) y(b)",
)
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(t.scored_multi, "y_true", "y_pred", range(10))


_COUNTS = """count(*) filter (y_true = 1 and y_pred = 1) as tp, count(*) filter (y_true = 0 and y_pred = 0) as tn,
    count(*) filter (y_true = 0 and y_pred = 1) as fp, count(*) filter (y_true = 1 and y_pred = 0) as fn"""
_F1 = f"""select tp, tn, fp, fn, {R('tp / nullif(tp + fp, 0)')} as precision, {R('tp / nullif(tp + fn, 0)')} as recall,
    {R('2 * tp / nullif(2 * tp + fp + fn, 0)')} as f1"""


@query("binary_counts", f"select {_COUNTS} from scored_binary")
def binary_counts(t: Tables) -> DataFrame:
    return metrics.binary_counts(t.scored_binary, "y_true", "y_pred")


@query("f1_binary", f"{_F1} from (select {_COUNTS} from scored_binary)")
def f1_binary(t: Tables) -> DataFrame:
    return rounded(metrics.f1_binary(t.scored_binary, "y_true", "y_pred"))


@query("f1_micro", f"select {R('avg(case when y_true = y_pred then 1 else 0 end)')} as f1 from scored_multi")
def f1_micro(t: Tables) -> DataFrame:
    return rounded(metrics.f1_multiclass(t.scored_multi, "y_true", "y_pred", "micro"))


@query(
    "f1_weighted",
    f"""select {R('sum(s * f) / sum(s)')} as f1 from (select c, (select count(*) from scored_multi where y_true = c) as s,
    (select 2 * count(*) filter (y_true = c and y_pred = c) / (count(*) filter (y_true = c) + count(*) filter (y_pred = c)) from scored_multi) as f
    from (select distinct y_true as c from scored_multi))""",
)
def f1_weighted(t: Tables) -> DataFrame:
    return rounded(metrics.f1_multiclass(t.scored_multi, "y_true", "y_pred", "weighted"))


@query("accuracy", f"select {R('avg(case when y_true = y_pred then 1 else 0 end)')} as accuracy from scored_multi")
def accuracy(t: Tables) -> DataFrame:
    return rounded(metrics.accuracy(t.scored_multi, "y_true", "y_pred"))


@query(
    "weighted_logloss",
    f"""select {R('-sum(w * m) / sum(w)')} as loss from (select avg(ln(greatest(1e-15, least(1 - 1e-15, p_true)))) as m,
    case when y_true in (3, 7) then 2.0 else 1.0 end as w from scored_multi group by y_true)""",
)
def weighted_logloss(t: Tables) -> DataFrame:
    return rounded(metrics.weighted_logloss(t.scored_multi, "y_true", "p_true", {3: 2.0, 7: 2.0}))


_SWEEP = """with d as (select y, p, lo, (hi - lo) / 1000 as step from (select {y} as y, {p} as p, min({p}) over () as lo, max({p}) over () as hi from {src})),
    g as (select i, min(lo) + i * min(step) as epsilon, count(*) filter (y = 1 and p < lo + i * step) as tp, count(*) filter (y = 0 and p >= lo + i * step) as tn,
    count(*) filter (y = 0 and p < lo + i * step) as fp, count(*) filter (y = 1 and p >= lo + i * step) as fn from d, range(1000) r(i) group by i)
    select """ + R("epsilon", 9) + " as epsilon, tp, tn, fp, fn, " + R("tp / (tp + fp)") + " as precision, " + R("tp / (tp + fn)") + " as recall, " + R("2 * tp / (2 * tp + fp + fn)") + """ as f1
    from g where tp > 0 order by 2 * tp / (2 * tp + fp + fn) desc, i limit 1"""


@query("threshold_sweep", _SWEEP.format(y="att_flag", p="(s2 * s1 / 100)", src="sensor_row"))
def threshold_sweep(t: Tables) -> DataFrame:
    data = t.sensor_row.select("att_flag", (F.col("s2") * F.col("s1") / 100).alias("p"))
    best = metrics.threshold_sweep(data, "att_flag", "p")
    return best.select(
        r("epsilon", 9).alias("epsilon"), "tp", "tn", "fp", "fn", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1")
    )


@query(
    "apply_threshold",
    f"""{_F1} from (select count(*) filter (att_flag = 1 and p < 5000) as tp, count(*) filter (att_flag = 0 and p >= 5000) as tn,
    count(*) filter (att_flag = 0 and p < 5000) as fp, count(*) filter (att_flag = 1 and p >= 5000) as fn from (select att_flag, s2 * s1 / 100 as p from sensor_row))""",
)
def apply_threshold(t: Tables) -> DataFrame:
    data = t.sensor_row.select("att_flag", (F.col("s2") * F.col("s1") / 100).alias("p"))
    return rounded(metrics.apply_threshold(data, "att_flag", "p", 5000.0))


_PRED = "(select id, y, 0.9 * y + 0.2 * x as pred from regression_xy)"


def _predicted(t: Tables) -> DataFrame:
    return t.regression_xy.select("id", "y", (0.9 * F.col("y") + 0.2 * F.col("x")).alias("pred"))


@query("mse", f"select {R('avg((y - pred) * (y - pred))')} as mse from {_PRED}")
def mse(t: Tables) -> DataFrame:
    return rounded(metrics.regression_scores(_predicted(t), "y", "pred").select("mse"))


@query("rmse", f"select {R('sqrt(avg((y - pred) * (y - pred)))')} as rmse from {_PRED}")
def rmse(t: Tables) -> DataFrame:
    return rounded(metrics.regression_scores(_predicted(t), "y", "pred").select("rmse"))


@query("r2", f"select {R('1 - sum((y - pred) * (y - pred)) / sum((y - m) * (y - m))')} as r2 from (select *, avg(y) over () as m from {_PRED})")
def r2(t: Tables) -> DataFrame:
    return rounded(metrics.regression_scores(_predicted(t), "y", "pred").select("r2"))


@query("msle", f"select {R('avg(pow(ln(1 + y) - ln(1 + pred), 2))', 9)} as msle from {_PRED}")
def msle(t: Tables) -> DataFrame:
    return rounded(metrics.msle(_predicted(t), "y", "pred"), 9)


@query(
    "binary_crossentropy",
    f"""select {R('-avg(y_true * ln(q) + (1 - y_true) * ln(1 - q))')} as loss from (select y_true, greatest(1e-15, least(1 - 1e-15, p)) as q from scored_binary)""",
)
def binary_crossentropy(t: Tables) -> DataFrame:
    return rounded(metrics.binary_crossentropy(t.scored_binary, "y_true", "p"))


@query("categorical_crossentropy", f"select {R('-avg(ln(greatest(1e-15, least(1 - 1e-15, p_true))))')} as loss from scored_multi")
def categorical_crossentropy(t: Tables) -> DataFrame:
    return rounded(metrics.categorical_crossentropy(t.scored_multi, "p_true"))


_MEANS = "(select config_id, avg(score) as mean_score, stddev_pop(score) as std_score from grid_scores group by 1)"
_ROUNDED_MEANS = f"(select config_id, round(mean_score, 9) as mean_score from {_MEANS})"


def _config_means(t: Tables) -> DataFrame:
    return t.grid_scores.groupBy("config_id").agg(F.round(F.avg("score"), 9).alias("mean_score"))


@query("grid_rank", f"select config_id, {R('mean_score')} as mean_score, rank() over (order by mean_score desc) as rank_score from {_ROUNDED_MEANS}")
def grid_rank(t: Tables) -> DataFrame:
    return rounded(rows.min_rank(_config_means(t), "mean_score", "rank_score"))


@query(
    "grid_summary",
    f"select config_id, {R('mean_score')} as mean_score, {R('std_score')} as std_score, rank() over (order by round(mean_score, 12) desc) as rank_score from {_MEANS}",
)
def grid_summary(t: Tables) -> DataFrame:
    return rounded(metrics.grid_summary(t.grid_scores, "config_id", "score"))


@query(
    "best_worst",
    f"""(select 'best' as which, {R('mean_score')} as score, config_id as ordinal from {_ROUNDED_MEANS} order by mean_score desc, config_id desc limit 1)
    union all (select 'worst', {R('mean_score')}, config_id from {_ROUNDED_MEANS} order by mean_score, config_id desc limit 1)""",
)
def best_worst(t: Tables) -> DataFrame:
    return rounded(metrics.best_worst(_config_means(t), "mean_score", "config_id", []))


@query("best_first", f"select config_id, {R('mean_score')} as mean_score from {_ROUNDED_MEANS} order by mean_score desc, config_id limit 1")
def best_first(t: Tables) -> DataFrame:
    return rounded(metrics.best_first(_config_means(t), "mean_score", "config_id"))


@query(
    "model_compare",
    "\nunion all ".join(
        f"select '{name}' as model, {R(f'2 * count(*) filter (y_true = 1 and {c}) / (count(*) filter (y_true = 1) + count(*) filter ({c}))')} as f1 from scored_binary"
        for name, c in [("above_0.3", "p > 0.3"), ("above_0.6", "p > 0.6"), ("all", "p >= 0")]
    ),
)
def model_compare(t: Tables) -> DataFrame:
    p = F.col("p")
    calls = {"above_0.3": p > 0.3, "above_0.6": p > 0.6, "all": p >= 0}
    out = None
    for name, c in calls.items():
        one = metrics.f1_binary(t.scored_binary, "y_true", c.cast("int")).select(F.lit(name).alias("model"), "f1")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# --- fits with a closed form ---


@query("linreg", f"select {R('regr_slope(y, x)')} as slope, {R('regr_intercept(y, x)')} as intercept from regression_xy")
def linreg(t: Tables) -> DataFrame:
    return rounded(models.line_fit(t.regression_xy, "x", "y"))


_RUN = ", ".join(f"sum({e}) over w as {s}, sum({e}) over () - sum({e}) over w as t{s}" for s, e in [("n", "1.0"), ("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("sxy", "x * y"), ("syy", "y * y")])


@query(
    "learning_curve",
    f"""with s as (select {_RUN} from regression_xy window w as (order by id rows unbounded preceding)),
    f as (select *, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0) as slope from s where tn >= 42),
    g as (select *, (sy - slope * sx) / n as b from f),
    h as (select *, tsyy - 2 * slope * tsxy - 2 * b * tsy + slope * slope * tsxx + 2 * slope * b * tsx + b * b * tn as sse from g)
    select cast(n as bigint) as k, {R('slope')} as slope, {R('b')} as intercept, {R('sse / tn')} as mse, {R('1 - sse / (tsyy - tsy * tsy / tn)')} as r2 from h""",
)
def learning_curve(t: Tables) -> DataFrame:
    return rounded(tune.learning_curve(t.regression_xy, "id", "x", "y", min_test=42))


@query(
    "cross_val_predict",
    f"""with p as (select *, row_number() over (order by id) - 1 as i, (select count(*) from orders) as c from regression_xy),
    f as (select *, cast(case when i < (c % 10) * (c // 10 + 1) then i // (c // 10 + 1) else c % 10 + (i - (c % 10) * (c // 10 + 1)) // (c // 10) end as integer) as fold from p),
    m as (select a.fold, regr_slope(b.y, b.x) as s, regr_intercept(b.y, b.x) as k from (select distinct fold from f) a join f b on a.fold <> b.fold group by 1)
    select id, f.fold, {R('s * x + k')} as prediction from f join m on f.fold = m.fold""",
)
def cross_val_predict(t: Tables) -> DataFrame:
    return rounded(tune.out_of_fold(t.regression_xy, "id", "x", "y"))


_CENTRES = [[0.5, 0.5], [2.5, 5.0], [4.5, 9.0]]
_GAP = "[" + ", ".join(f"(s1 - {a}) * (s1 - {a}) + (s2 - {b}) * (s2 - {b})" for a, b in _CENTRES) + "]"


@query(
    "kmeans_step",
    f"""select cast(list_position(g, list_min(g)) - 1 as integer) as cluster, count(*) as n, {R('avg(s1)')} as s1, {R('avg(s2)')} as s2
    from (select *, {_GAP} as g from {_SCALED}) group by 1""",
)
def kmeans_step(t: Tables) -> DataFrame:
    return rounded(models.kmeans_step(scaled_sensors(t), ["s1", "s2"], _CENTRES))


_NORMAL = """select row_key, {expr} as log_density from {src}, (select avg(s1) as m1, avg(s2) as m2, var_samp(s1) as a, var_samp(s2) as d, covar_samp(s1, s2) as b from {src})"""


@query(
    "gaussian_anomaly",
    _NORMAL.format(
        src=_SCALED,
        expr=R("-0.5 * (2 * ln(2 * pi()) + ln(a * d - b * b) + (d * (s1 - m1) * (s1 - m1) - 2 * b * (s1 - m1) * (s2 - m2) + a * (s2 - m2) * (s2 - m2)) / (a * d - b * b))"),
    ),
)
def gaussian_anomaly(t: Tables) -> DataFrame:
    data = scaled_sensors(t)
    return rounded(data.select("row_key", fit_gaussian(data, ["s1", "s2"]).log_density().alias("log_density")))


@query(
    "gaussian_diag",
    _NORMAL.format(
        src=_SCALED, expr=R("-0.5 * (ln(2 * pi()) + ln(a) + (s1 - m1) * (s1 - m1) / a + ln(2 * pi()) + ln(d) + (s2 - m2) * (s2 - m2) / d)")
    ),
)
def gaussian_diag(t: Tables) -> DataFrame:
    data = scaled_sensors(t)
    return rounded(data.select("row_key", fit_gaussian(data, ["s1", "s2"]).diagonal_log_density().alias("log_density")))


"""Queries: scalar functions, missing values, codes, bins, scaling, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions import arrays, dates, maths, text
from tabflow.operators import clean, encode, images, scale, stats
from tabflow.plans.registry import R, Tables, query, r, rounded
from tabflow.plans.tables import orders_with_gaps

_GAPS = """(select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderstatus end as o_orderstatus,
    case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_orderpriority from orders)"""

# --- text and time ---


@query(
    "parse_currency",
    "select id, cast(floor(o_totalprice) as bigint) as price from money_text join orders on o_orderkey = id",
)
def parse_currency(t: Tables) -> DataFrame:
    return t.money_text.select("id", text.parse_currency(F.col("price")).alias("price"))


@query(
    "parse_thousands",
    "select id, cast(floor(o_totalprice) as bigint) as riders from money_text join orders on o_orderkey = id",
)
def parse_thousands(t: Tables) -> DataFrame:
    return t.money_text.select("id", text.parse_thousands(F.col("riders")).alias("riders"))


@query("extract_title", "select passenger_id, split_part(split_part(name, ', ', 2), '.', 1) as title from passenger")
def extract_title(t: Tables) -> DataFrame:
    return t.passenger.select("passenger_id", text.after_comma_word(F.col("name")).alias("title"))


@query("extract_prefix", "select passenger_id, split_part(name, ', ', 1) as surname from passenger")
def extract_prefix(t: Tables) -> DataFrame:
    return t.passenger.select("passenger_id", text.before_comma(F.col("name")).alias("surname"))


_HOUR = "cast(extract('hour' from strptime(datetime, '%d/%m/%y %H')) as integer)"
_DAY = "cast(extract('day' from strptime(datetime, '%d/%m/%y %H')) as integer)"
_MONTH = "cast(extract('month' from strptime(datetime, '%d/%m/%y %H')) as integer)"


@query(
    "datetime_parts",
    f"""select event_id, {_HOUR} as hour, {_DAY} as day, {_MONTH} as month
    from (select event_id, strftime(ts, '%d/%m/%y %H') as datetime from events)""",
)
def datetime_parts(t: Tables) -> DataFrame:
    stamped = t.events.select("event_id", F.date_format("ts", dates.SENSOR_FORMAT).alias("datetime"))
    parts = dates.datetime_parts(F.col("datetime"))
    return stamped.select("event_id", parts["time"].alias("hour"), parts["day"].alias("day"), parts["month"].alias("month"))


@query(
    "datetime_cyclic",
    "select event_id, "
    + ", ".join(
        f"{R(f'{fn}({part})')} as {name}_{word}"
        for name, part in [("time", _HOUR), ("day", _DAY), ("month", _MONTH)]
        for fn, word in [("sin", "sine"), ("cos", "cosine")]
    )
    + " from (select event_id, strftime(ts, '%d/%m/%y %H') as datetime from events)",
)
def datetime_cyclic(t: Tables) -> DataFrame:
    stamped = t.events.select("event_id", F.date_format("ts", dates.SENSOR_FORMAT).alias("datetime"))
    return stamped.select("event_id", *[r(c).alias(n) for n, c in dates.datetime_cyclic(F.col("datetime")).items()])


@query(
    "coerce_numeric",
    """select s_suppkey, try_cast(case when s_nationkey = 2 then s_name else concat(cast(s_suppkey as varchar), '.5') end as double) as value
    from supplier""",
)
def coerce_numeric(t: Tables) -> DataFrame:
    mixed = F.when(F.col("s_nationkey") == 2, F.col("s_name")).otherwise(F.concat(F.col("s_suppkey").cast("string"), F.lit(".5")))
    return t.supplier.select("s_suppkey", text.coerce_number(mixed).alias("value"))


# --- arithmetic ---


@query("poly_features", "select row_key, " + ", ".join(f"{R(f'pow(a, {i - j}) * pow(b, {j})')} as f{i}{j}" for i in range(1, 7) for j in range(i)) + ", 1 as ones from (select row_key, s1 / 50 as a, s3 * 10 as b from sensor_row)")
def poly_features(t: Tables) -> DataFrame:
    made = maths.powers(F.col("s1") / 50, F.col("s3") * 10)
    return rounded(t.sensor_row.select("row_key", *[c.alias(n) for n, c in made.items()], F.lit(1).alias("ones")))


@query("sigmoid", f"select row_key, {R('1 / (1 + exp(-(s1 / 10 - 2)))')} as p from sensor_row")
def sigmoid(t: Tables) -> DataFrame:
    return rounded(t.sensor_row.select("row_key", maths.sigmoid(F.col("s1") / 10 - 2).alias("p")))


@query("clip_log", f"select id, {R('ln(greatest(1e-15, least(1 - 1e-15, p)))')} as log_p from scored_binary")
def clip_log(t: Tables) -> DataFrame:
    return rounded(t.scored_binary.select("id", maths.clip_log(F.col("p")).alias("log_p")))


@query("round_up_down", "select row_key, cast(ceil(s2 / 7) as bigint) as up, cast(floor(s2 / 7) as bigint) as down, pow(s1, 2) as squared from sensor_row")
def round_up_down(t: Tables) -> DataFrame:
    x = F.col("s2") / 7
    return t.sensor_row.select("row_key", F.ceil(x).alias("up"), F.floor(x).alias("down"), F.pow("s1", F.lit(2.0)).alias("squared"))


@query("threshold_binary", "select id, case when p > 0.5 then 1 else 0 end as above, case when p >= 0.5 then 1 else 0 end as reached from scored_binary")
def threshold_binary(t: Tables) -> DataFrame:
    p = F.col("p")
    return t.scored_binary.select("id", maths.threshold(p, 0.5).alias("above"), maths.threshold(p, 0.5, inclusive=True).alias("reached"))


@query(
    "cast_types",
    """select l_orderkey, l_linenumber, cast(cast(l_linenumber as varchar) as bigint) as number, cast(l_quantity > 25 as integer) as many,
    cast(l_tax as float) as tax from lineitem""",
)
def cast_types(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").cast("long").alias("number"),
        (F.col("l_quantity") > 25).cast("int").alias("many"), F.col("l_tax").cast("float").alias("tax"),
    )


def _uniform(key: str, seed: str) -> str:
    return f"((('0x' || substr(md5(concat(cast({key} as varchar), '{seed}')), 1, 13))::bigint + 0.5) / 4503599627370496)"


@query(
    "add_noise",
    f"""select row_key, {R(f"1e-4 * sqrt(-2 * ln({_uniform('row_key', '157s3r')})) * cos(2 * pi() * {_uniform('row_key', '157s3a')})", 12)} as s3 from sensor_row""",
)
def add_noise(t: Tables) -> DataFrame:
    return rounded(clean.add_noise(t.sensor_row.select("row_key", "s3"), "row_key", ["s3"]), 12)


# --- missing values ---


@query("impute_constant", f"select o_orderkey, coalesce(o_orderstatus, 'NA') as o_orderstatus, coalesce(o_totalprice, 0.0) as o_totalprice, o_orderpriority from {_GAPS}")
def impute_constant(t: Tables) -> DataFrame:
    return orders_with_gaps(t).na.fill({"o_orderstatus": "NA", "o_totalprice": 0.0})


_MODE = f"(select o_orderstatus from {_GAPS} where o_orderstatus is not null group by 1 order by count(*) desc, 1 limit 1)"


@query("impute_mode", f"select o_orderkey, coalesce(o_orderstatus, {_MODE}) as o_orderstatus, o_totalprice, o_orderpriority from {_GAPS}")
def impute_mode(t: Tables) -> DataFrame:
    return clean.impute_mode(orders_with_gaps(t), ["o_orderstatus"])


_TITLED = "(select *, split_part(split_part(name, ', ', 2), '.', 1) as title from passenger)"
_JITTER = "(((passenger_id % 2147483648) * 1103515245 + 12345 + 157) % 2147483648) // 65536 % 12 - 6"


@query(
    "impute_group_mean",
    f"""select passenger_id, title, coalesce(age, ceil(avg(age) over (partition by title))
    + case when title in ('Mr', 'Mrs', 'Miss') then {_JITTER} else 0 end) as age from {_TITLED}""",
)
def impute_group_mean(t: Tables) -> DataFrame:
    titled = t.passenger.select("passenger_id", text.after_comma_word(F.col("name")).alias("title"), "age")
    return clean.impute_group_mean(titled, "passenger_id", "title", "age", ["Mr", "Mrs", "Miss"])


@query("lookup_group_mean", f"select passenger_id, title, age, {R('avg(age) over (partition by title)')} as mean_age from {_TITLED}")
def lookup_group_mean(t: Tables) -> DataFrame:
    titled = t.passenger.select("passenger_id", text.after_comma_word(F.col("name")).alias("title"), "age")
    return clean.lookup_group_mean(titled, "title", "age", "mean_age").withColumn("mean_age", r("mean_age"))


_WILD = """(select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 11 = 0 then 'nan'::double when l_partkey % 13 = 0 then 'inf'::double
    when l_partkey % 17 = 0 then '-inf'::double else l_extendedprice end as x from lineitem)"""


@query(
    "impute_median_inf",
    f"""with w as (select *, case when isfinite(x) then x end as f from {_WILD}), s as (select min(f) as lo, max(f) as hi, median(f) as mid from w)
    select l_orderkey, l_linenumber, l_partkey, {R("case when x = 'inf'::double then hi when x = '-inf'::double then lo when isnan(x) then mid else x end")} as x
    from w, s""",
)
def impute_median_inf(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    wild = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(float("inf"))).when(k % 17 == 0, F.lit(float("-inf")))
    data = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", wild.otherwise(F.col("l_extendedprice")).alias("x"))
    return rounded(clean.impute_median_inf(data, ["x"]))


# --- codes and bins ---


@query(
    "label_encode",
    "select p_partkey, p_type, (select count(distinct q.p_type) from part q where q.p_type < part.p_type) as p_type_code from part",
)
def label_encode(t: Tables) -> DataFrame:
    return encode.label_encode(t.part.select("p_partkey", "p_type"), "p_type")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("one_hot", "select event_id, " + ", ".join(f"case when event_type = '{v}' then 1 else 0 end as event_type_{v}" for v in _TYPES) + " from events")
def one_hot(t: Tables) -> DataFrame:
    return encode.one_hot(t.events.select("event_id", "event_type"), ["event_type"])


@query(
    "bin_equal_width",
    """with e as (select floor(lo + (hi - lo) / 5.0) as a, floor(lo + 2 * (hi - lo) / 5.0) as b, floor(lo + 3 * (hi - lo) / 5.0) as c,
    floor(lo + 4 * (hi - lo) / 5.0) as d from (select min(p_size)::double as lo, max(p_size)::double as hi from part))
    select p_partkey, case when p_size <= a then 0 when p_size <= b then 1 when p_size <= c then 2 when p_size <= d then 3 else 4 end as size_range
    from part, e""",
)
def bin_equal_width(t: Tables) -> DataFrame:
    edges = encode.equal_width_edges(t.part, "p_size", 5)
    return t.part.select("p_partkey", encode.bin_by_edges(F.col("p_size"), edges).alias("size_range"))


@query(
    "bin_quantile",
    """with e as (select quantile_cont(fare, [0.25, 0.5, 0.75]) as q from passenger)
    select passenger_id, case when fare is null then 0 when fare <= q[1] then 0 when fare <= q[2] then 1 when fare <= q[3] then 2 else 3 end as fare_range
    from passenger, e""",
)
def bin_quantile(t: Tables) -> DataFrame:
    edges = encode.quantile_edges(t.passenger, "fare", 4)
    return t.passenger.select("passenger_id", encode.bin_by_edges(F.col("fare"), edges).alias("fare_range"))


# --- scaling and column choice ---

_SENSORS = ["s1", "s2", "s3", "s4"]


@query(
    "standardise",
    "select row_key, " + ", ".join(R(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()") + f" as {c}" for c in _SENSORS) + ", 0.0::double as fixed from sensor_row",
)
def standardise(t: Tables) -> DataFrame:
    data = t.sensor_row.select("row_key", *_SENSORS, F.lit(3.3).alias("fixed"))
    return rounded(scale.standardise(data, [*_SENSORS, "fixed"]))


@query(
    "standardise_per_split",
    "select row_key, att_flag, "
    + ", ".join(R(f"({c} - avg({c}) over (partition by att_flag)) / stddev_pop({c}) over (partition by att_flag)") + f" as {c}" for c in _SENSORS)
    + " from sensor_row",
)
def standardise_per_split(t: Tables) -> DataFrame:
    return rounded(scale.standardise_by(t.sensor_row.select("row_key", "att_flag", *_SENSORS), "att_flag", _SENSORS))


@query(
    "robust_scale",
    "select row_key, "
    + ", ".join(R(f"({c} - m_{c}) / (q_{c}[2] - q_{c}[1])") + f" as {c}" for c in _SENSORS)
    + " from sensor_row, (select "
    + ", ".join(f"median({c}) as m_{c}, quantile_cont({c}, [0.25, 0.75]) as q_{c}" for c in _SENSORS)
    + " from sensor_row)",
)
def robust_scale(t: Tables) -> DataFrame:
    data = t.sensor_row.select("row_key", *_SENSORS)
    return rounded(scale.fit_robust(data, _SENSORS).transform(data))


@query(
    "minmax_scale",
    "select row_key, " + ", ".join(R(f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ())") + f" as {c}" for c in _SENSORS) + " from sensor_row",
)
def minmax_scale(t: Tables) -> DataFrame:
    data = t.sensor_row.select("row_key", *_SENSORS)
    return rounded(scale.fit_minmax(data, _SENSORS).transform(data))


@query("sum_normalise", f"select row_key, {R('1000 * s1 / sum(s1) over ()', 9)} as s1, {R('1000 * s2 / sum(s2) over ()', 9)} as s2 from sensor_row")
def sum_normalise(t: Tables) -> DataFrame:
    shares = scale.sum_normalise(t.sensor_row.select("row_key", "s1", "s2"), ["s1", "s2"])
    return rounded(shares.select("row_key", (1000 * F.col("s1")).alias("s1"), (1000 * F.col("s2")).alias("s2")), 9)


@query("rank_reduce", "select row_key, s1, s2, s4 from sensor_row")
def rank_reduce(t: Tables) -> DataFrame:
    data = t.sensor_row.withColumns({"twice": F.col("s1") * 2, "mixed": F.col("s1") - F.col("s2") / 1000})
    return data.select("row_key", *scale.independent_columns(data, ["s1", "twice", "s2", "mixed", "s4"]))


@query("pca_whiten", "select cast(a as integer) as i, cast(b as integer) as j, 0.0::double as mean, case when a = b then 1.0::double else 0.0::double end as cov from range(8) x(a), range(8) y(b) where a <= b")
def pca_whiten(t: Tables) -> DataFrame:
    """Whitened components have mean 0, variance 1 and no covariance."""
    white = scale.fit_pca(t.image, "pixels", 8).whiten(t.image, "pixels").select("image_id", *[F.col("whitened")[i].alias(str(i)) for i in range(8)])
    found = stats.mean_cov(white, [str(i) for i in range(8)])
    return rounded(found.select(F.col("col_i").cast("int").alias("i"), F.col("col_j").cast("int").alias("j"), F.col("mean_i").alias("mean"), "cov"))


@query("feature_clusters", "select image_id, 10 as n_kept, true as are_entries from image")
def feature_clusters(t: Tables) -> DataFrame:
    """Ten different entries of the vector are kept."""
    kept = scale.feature_clusters(t.image, "pixels", 10, 8)
    entries = F.array(*[F.col("pixels")[i] for i in kept])
    rising = kept == sorted(set(kept)) and 0 <= kept[0] and kept[-1] < 64
    return t.image.select("image_id", F.size(entries).alias("n_kept"), (F.forall(entries, lambda v: v.isNotNull()) & F.lit(rising)).alias("are_entries"))


# --- arrays and images ---


@query(
    "pixel_scale",
    f"""select image_id, pos, {R('cast(cast(v / 255 as float) as double)', 9)} as v
    from (select image_id, unnest(pixels) as v, cast(generate_subscripts(pixels, 1) - 1 as integer) as pos from image)""",
)
def pixel_scale(t: Tables) -> DataFrame:
    scaled = t.image.select("image_id", F.posexplode(arrays.scale_pixels(F.col("pixels"))).alias("pos", "v"))
    return rounded(scaled.withColumn("v", F.col("v").cast("double")), 9)


@query(
    "pixel_reshape",
    """select image_id, i // 8 as y, i % 8 as x, v from (select image_id, unnest(pixels) as v,
    cast(generate_subscripts(pixels, 1) - 1 as integer) as i from image)""",
)
def pixel_reshape(t: Tables) -> DataFrame:
    shaped = t.image.select("image_id", arrays.add_channel(arrays.to_rows(F.col("pixels"), 8)).alias("rows"))
    lines = shaped.select("image_id", F.posexplode("rows").alias("y", "line"))
    return lines.select("image_id", "y", F.posexplode("line").alias("x", "cell")).select("image_id", "y", "x", F.col("cell")[0].alias("v"))


@query("image_augment", "select image_id, 64 as n_pixels, true as in_range, true as moved from image")
def image_augment(t: Tables) -> DataFrame:
    """Size stays, values stay within those of the image or empty, and something moved."""
    out = images.augment(t.image, "image_id", "pixels", 8).select("image_id", F.col("pixels").alias("after")).join(t.image.select("image_id", "pixels"), "image_id")
    low, high = F.least(F.array_min("pixels"), F.lit(0.0)), F.greatest(F.array_max("pixels"), F.lit(0.0))
    inside = (F.array_min("after") >= low - 1e-6) & (F.array_max("after") <= high + 1e-6)
    return out.select("image_id", F.size("after").alias("n_pixels"), inside.alias("in_range"), (F.col("after") != F.col("pixels")).alias("moved"))


@query("image_sample", "select image_id, label from image order by md5(concat(cast(image_id as varchar), '157')), image_id limit 9")
def image_sample(t: Tables) -> DataFrame:
    return images.sample_images(t.image, "image_id").select("image_id", "label")

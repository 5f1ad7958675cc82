"""Feature pipelines: the operators put together for light curves, passengers, houses and sensors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions import text
from tabflow.functions.hashing import integer_jitter
from tabflow.functions.maths import ratio_squared
from tabflow.operators import anomaly, clean, encode, metrics, rows, scale, series
from tabflow.plans.registry import R, Tables, query, rounded
from tabflow.plans.tables import KEPT_TITLES, collapse_titles
from tabflow.session import attach, cut_lineage

# Metadata columns that are not features.
NOT_FEATURES = ["distmod", "hostgal_specz", "target", "object_id", "decl", "hostgal_photoz", "hostgal_photoz_err"]


def light_curve_statistics(data: DataFrame, bands: Sequence, method: str = "old", letters: dict | None = None) -> DataFrame:
    """Scaled per-band statistics and detection rates of each object, from one scan of the points.

    ``method='new'`` adds the error-weighted sums and the detected time span, scaled as well.
    """
    if method not in ("old", "new"):
        raise ValueError("method must be 'old' or 'new'")
    at = F.when(F.col("detected") == 1, F.col("mjd"))
    rtsq, flrt = series.flux_ratio_sums("flux", "flux_err")
    extra = [series.detected_rate("detected").alias("det_avg")]
    if method == "new":
        extra += [rtsq.alias("rtsq"), flrt.alias("flrt"), F.min(at).alias("first"), F.max(at).alias("last")]
    long = series.band_stats_long(data, "object_id", "passband", "flux", extra)
    names = [*series.STATS, "det_avg", *(["rtsq", "flrt"] if method == "new" else [])]
    letters = letters or {}
    cells = [
        F.max(F.when(F.col("passband") == F.lit(b), F.col(s))).alias(f"{s}_{letters.get(b, b)}") for s in names for b in bands
    ]
    if method == "new":
        cells.append((F.max("last") - F.min("first")).alias("mjd_diff"))
    # One row per object. It is read twice, for the scaler and for its result, the points once.
    wide = cut_lineage(long.groupBy("object_id").agg(*cells))
    scaled = [c for c in wide.columns if c != "object_id" and not c.startswith("det_avg_")]
    return scale.standardise(wide, scaled)


def light_curve_features(data: DataFrame, metadata: DataFrame, bands: Sequence, method: str = "old", letters: dict | None = None) -> DataFrame:
    """Scaled metadata, the deep-field flag and the statistics of each object, with its label."""
    ratio = ratio_squared(F.col("hostgal_photoz"), F.col("hostgal_photoz_err"), 0.0)
    base = metadata.withColumn("hostgal_ph_ratio_sq", ratio)
    features = [c for c in base.columns if c not in NOT_FEATURES and c != "ddf"]
    scaled = scale.standardise(base.select("object_id", "ddf", "target", *features), features)
    return scaled.join(light_curve_statistics(data, bands, method, letters), "object_id")


BANDS = ["click", "error", "purchase", "signup", "view"]


def _features_sql(method: str) -> str:
    stats = {"mn": "avg(flux)", "md": "median(flux)", "mx": "max(flux)", "mi": "min(flux)", "st": "stddev_samp(flux)"}
    if method == "new":
        stats |= {"rtsq": "sum(pow(flux / flux_err, 2))", "flrt": "sum(flux * pow(flux / flux_err, 2))"}
    plain = {"det_avg": "avg(detected)"}
    cells = [f"{e} filter (passband = '{b}') as {s}_{b}" for s, e in (stats | plain).items() for b in BANDS]
    names = [f"{s}_{b}" for s in stats for b in BANDS]
    if method == "new":
        cells.append("max(mjd) filter (detected = 1) - min(mjd) filter (detected = 1) as mjd_diff")
        names.append("mjd_diff")

    def z(c):
        return R(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()")

    return f"""with w as (select object_id, {', '.join(cells)} from light_curve_obs group by 1),
    s as (select object_id, {', '.join(f'{z(c)} as {c}' for c in names)}, {', '.join(f'{R(f"det_avg_{b}")} as det_avg_{b}' for b in BANDS)} from w),
    m as (select object_id, ddf, target, {z('h')} as hostgal_ph_ratio_sq from (select *, coalesce(pow(hostgal_photoz / hostgal_photoz_err, 2), 0) as h from object_meta))
    select m.*, s.* exclude (object_id) from m join s on m.object_id = s.object_id"""


@query("light_curve_features", _features_sql("new"))
def light_curve_features_query(t: Tables) -> DataFrame:
    return rounded(light_curve_features(t.light_curve_obs, t.object_meta, BANDS, "new"))


@query("light_curve_features_old", _features_sql("old"))
def light_curve_features_old_query(t: Tables) -> DataFrame:
    return rounded(light_curve_features(t.light_curve_obs, t.object_meta, BANDS, "old"))


@dataclass(frozen=True)
class PassengerFeatures:
    """What was learnt from one table of passengers: codes, means, edges, categories and scales; ``transform`` prepares any other alike.

    A surname that was not seen has no code and is scaled as NULL, a title that was not seen has no mean age, an age or fare
    beyond the edges is in the outer bin. Rows without a port are left out, as in the fit.
    """

    key: str
    keep: list[str]
    categorical: list[str]
    seed: int
    surnames: DataFrame
    mean_age: DataFrame
    ages: list[float]
    fares: list[float]
    values: dict[str, list]
    scaler: scale.Affine | None = None

    def _filled(self, df: DataFrame) -> DataFrame:
        known = df.filter(F.col("embarked").isNotNull()).withColumns(
            {
                "title": text.after_comma_word(F.col("name")),
                "surname": text.before_comma(F.col("name")),
                "alone": ((F.col("sibsp") == 0) & (F.col("parch") == 0)).cast("int"),
                "family_count": F.col("sibsp") + F.col("parch"),
            }
        )
        coded = encode.label_encode(known, "surname", codes=self.surnames).drop("surname")
        jitter = F.when(F.col("title").isin(["Mr", "Mrs", "Miss"]), integer_jitter(self.key, self.seed)).otherwise(F.lit(0))
        filled = attach(coded, self.mean_age, ["title"])
        return filled.withColumn("age", F.coalesce("age", F.ceil("__mean").cast("double") + jitter)).drop("__mean")

    def _coded(self, filled: DataFrame) -> DataFrame:
        binned = filled.withColumns(
            {
                "age_range": encode.bin_by_edges(F.col("age"), self.ages),
                "fare_range": encode.bin_by_edges(F.col("fare"), self.fares),
                "title": collapse_titles(F.col("title")),
            }
        )
        kept = binned.select(self.key, *[c for c in self.keep if c in binned.columns], "surname_code", "alone", "family_count", *self.categorical, "age_range", "fare_range", "title")
        return encode.one_hot(kept, [*self.categorical, "age_range", "fare_range", "title"], self.values)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self._coded(self._filled(df)))


def fit_passengers(df: DataFrame, key: str, label: str, categorical: Sequence[str] = ("embarked",), seed: int = 157) -> PassengerFeatures:
    """Learn all that the feature table of passengers needs; the label is carried along where a table has it."""
    known = cut_lineage(
        df.filter(F.col("embarked").isNotNull()).withColumns({"title": text.after_comma_word(F.col("name")), "surname": text.before_comma(F.col("name"))})
    )
    surnames = cut_lineage(encode.label_codes(known, "surname"))
    mean_age = cut_lineage(known.groupBy("title").agg(F.avg("age").alias("__mean")))
    values = {"age_range": list(range(5)), "fare_range": list(range(4)), "title": sorted([*KEPT_TITLES, "Other"])}
    values |= {c: encode.categories(known, c) for c in categorical}
    fit = PassengerFeatures(key, [label], list(categorical), seed, surnames, mean_age, [], [], values)
    filled = cut_lineage(fit._filled(df))
    fit = replace(fit, ages=encode.equal_width_edges(filled, "age", 5), fares=encode.quantile_edges(filled, "fare", 4))
    coded = fit._coded(filled)
    return replace(fit, scaler=scale.fit_standard(coded, [c for c in coded.columns if c not in (key, label)]))


def passenger_features(df: DataFrame, key: str, label: str, categorical: Sequence[str] = ("embarked",), seed: int = 157) -> DataFrame:
    """Scaled feature table of passengers: titles, family, imputed and binned age, binned fare, indicators."""
    return fit_passengers(df, key, label, categorical, seed).transform(df)


_TITLE = "split_part(split_part(name, ', ', 2), '.', 1)"
_JITTER = "(((passenger_id % 2147483648) * 1103515245 + 12345 + 157) % 2147483648) // 65536 % 12 - 6"
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _passenger_sql() -> str:
    flags = {f"embarked_{s}": f"embarked = '{s}'" for s in _SEGMENTS}
    flags |= {f"age_range_{i}": f"age_range = {i}" for i in range(5)}
    flags |= {f"fare_range_{i}": f"fare_range = {i}" for i in range(4)}
    flags |= {f"title_{v}": f"short = '{v}'" for v in [*KEPT_TITLES, "Other"]}
    columns = {"surname_code": "surname_code", "alone": "alone", "family_count": "family_count"}
    columns |= {n: f"case when {c} then 1 else 0 end" for n, c in flags.items()}
    z = ", ".join(f"{R(f'coalesce(({e} - avg({e}) over ()) / nullif(stddev_pop({e}) over (), 0), 0)')} as {n}" for n, e in columns.items())
    return f"""with a as (select *, {_TITLE} as title, case when sibsp = 0 and parch = 0 then 1 else 0 end as alone, sibsp + parch as family_count,
    dense_rank() over (order by split_part(name, ', ', 1)) - 1 as surname_code from passenger where embarked is not null),
    b as (select * exclude (age), coalesce(age, ceil(avg(age) over (partition by title)) + case when title in ('Mr', 'Mrs', 'Miss') then {_JITTER} else 0 end) as age,
    case when title = 'Mme' then 'Miss' when title in ('Mr', 'Mrs', 'Miss', 'Master') then title else 'Other' end as short from a),
    e as (select min(age) as lo, max(age) as hi, quantile_cont(fare, [0.25, 0.5, 0.75]) as q from b),
    c as (select b.*, case when age <= floor(lo + (hi - lo) / 5) then 0 when age <= floor(lo + 2 * (hi - lo) / 5) then 1 when age <= floor(lo + 3 * (hi - lo) / 5) then 2
    when age <= floor(lo + 4 * (hi - lo) / 5) then 3 when age is null then 0 else 4 end as age_range,
    case when fare is null then 0 when fare <= q[1] then 0 when fare <= q[2] then 1 when fare <= q[3] then 2 else 3 end as fare_range from b, e)
    select passenger_id, survived, {z} from c"""


@query("passenger_features", _passenger_sql())
def passenger_features_query(t: Tables) -> DataFrame:
    return rounded(passenger_features(t.passenger, "passenger_id", "survived"))


@dataclass(frozen=True)
class HouseFeatures:
    """Fills, codes of text columns and scales learnt from one table; a text that was not seen has no code and is scaled as NULL."""

    fill: dict
    required: list[str]
    codes: dict[str, DataFrame]
    scaler: scale.Affine | None = None

    def _coded(self, df: DataFrame) -> DataFrame:
        full = df.na.fill(self.fill).na.drop(subset=self.required)
        for c, codes in self.codes.items():
            full = encode.label_encode(full, c, codes=codes).drop(c).withColumnRenamed(f"{c}_code", c)
        return full

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self._coded(df))


def fit_houses(train: DataFrame, key: str, label: str, fill: dict, required: Sequence[str]) -> HouseFeatures:
    full = train.na.fill(fill).na.drop(subset=list(required))
    codes = {c: cut_lineage(encode.label_codes(full, c)) for c in clean.columns_of_type(full, "string")}
    fit = HouseFeatures(fill, list(required), codes)
    coded = fit._coded(train)
    return replace(fit, scaler=scale.fit_standard(coded, [c for c in coded.columns if c not in (key, label)]))


def house_features(train: DataFrame, key: str, label: str, fill: dict, required: Sequence[str]) -> DataFrame:
    """Fill gaps, drop rows without the required columns, encode text columns, scale."""
    return fit_houses(train, key, label, fill, required).transform(train)


@query(
    "house_features",
    "select id, sale_price, "
    + ", ".join(R(f"(({e}) - avg({e}) over ()) / stddev_pop({e}) over ()") + f" as {c}" for c, e in [("lot_frontage", "f"), ("alley", "a"), ("sale_type", "s")])
    + """ from (select id, sale_price, coalesce(lot_frontage, 0) as f, dense_rank() over (order by coalesce(alley, 'NA')) as a,
    dense_rank() over (order by sale_type) as s from house where sale_type is not null)""",
)
def house_features_query(t: Tables) -> DataFrame:
    return rounded(house_features(t.house, "id", "sale_price", {"lot_frontage": 0.0, "alley": "NA"}, ["sale_type"]))


_PARTS = """with x as (select *, case when row_number() over (order by md5(concat(cast({key} as varchar), '157'))) <= ceil(0.2 * (select count(*) from {table})) then 1 else 0 end as is_test from {table}"""


def _apart(e: str, name: str) -> str:
    """A column of the test rows on the scale of the training rows."""
    spread = f"(select stddev_pop({e}) from j where is_test = 0)"
    return R(f"(({e}) - (select avg({e}) from j where is_test = 0)) / case when {spread} = 0 then 1 else {spread} end") + f" as {name}"


@query(
    "house_fit_transform",
    _PARTS.format(key="id", table="house")
    + f"""), f as (select id, sale_price, is_test, coalesce(lot_frontage, 0) as f, coalesce(alley, 'NA') as a, sale_type as s from x where sale_type is not null),
    ca as (select a, row_number() over (order by a) - 1 as ac from (select distinct a from f where is_test = 0)),
    cs as (select s, row_number() over (order by s) - 1 as sc from (select distinct s from f where is_test = 0)),
    j as (select f.*, ac, sc from f left join ca on f.a = ca.a left join cs on f.s = cs.s)
    select id, sale_price, {_apart('f', 'lot_frontage')}, {_apart('ac', 'alley')}, {_apart('sc', 'sale_type')} from j where is_test = 1""",
)
def house_fit_transform(t: Tables) -> DataFrame:
    """Learnt from four fifths of the rows, applied to the rest."""
    parts = cut_lineage(rows.split_random(t.house, "id", 0.2))
    train, test = (parts.filter(F.col("is_test") == i).drop("is_test") for i in (0, 1))
    return rounded(fit_houses(train, "id", "sale_price", {"lot_frontage": 0.0, "alley": "NA"}, ["sale_type"]).transform(test))


@query(
    "passenger_fit_transform",
    _PARTS.format(key="passenger_id", table="passenger")
    + f"""), a as (select *, {_TITLE} as title, split_part(name, ', ', 1) as surname, case when sibsp = 0 and parch = 0 then 1 else 0 end as alone, sibsp + parch as family_count
    from x where embarked is not null),
    c as (select surname, row_number() over (order by surname) - 1 as surname_code from (select distinct surname from a where is_test = 0)),
    m as (select title, avg(age) as mean from a where is_test = 0 group by 1),
    b as (select a.* exclude (age), surname_code, coalesce(a.age, ceil(mean) + case when a.title in ('Mr', 'Mrs', 'Miss') then {_JITTER} else 0 end) as age,
    case when a.title = 'Mme' then 'Miss' when a.title in ('Mr', 'Mrs', 'Miss', 'Master') then a.title else 'Other' end as short from a left join c on a.surname = c.surname left join m on a.title = m.title),
    e as (select min(age) as lo, max(age) as hi, quantile_cont(fare, [0.25, 0.5, 0.75]) as q from b where is_test = 0),
    j as (select b.*, case when age is null then 0 when age <= floor(lo + (hi - lo) / 5) then 0 when age <= floor(lo + 2 * (hi - lo) / 5) then 1 when age <= floor(lo + 3 * (hi - lo) / 5) then 2
    when age <= floor(lo + 4 * (hi - lo) / 5) then 3 else 4 end as age_range,
    case when fare is null then 0 when fare <= q[1] then 0 when fare <= q[2] then 1 when fare <= q[3] then 2 else 3 end as fare_range from b, e)
    select passenger_id, survived, {_apart('surname_code', 'surname_code')}, {_apart('alone', 'alone')}, {_apart('family_count', 'family_count')},
    """
    + ", ".join(
        _apart(f"case when {c} then 1 else 0 end", n)
        for n, c in [
            *((f"embarked_{s}", f"embarked = '{s}'") for s in _SEGMENTS), *((f"age_range_{i}", f"age_range = {i}") for i in range(5)),
            *((f"fare_range_{i}", f"fare_range = {i}") for i in range(4)), *((f"title_{v}", f"short = '{v}'") for v in [*KEPT_TITLES, "Other"]),
        ]
    )
    + " from j where is_test = 1",
)
def passenger_fit_transform(t: Tables) -> DataFrame:
    """Learnt from four fifths of the passengers, applied to the rest, some of whose surnames are new."""
    parts = cut_lineage(rows.split_random(t.passenger, "passenger_id", 0.2))
    train, test = (parts.filter(F.col("is_test") == i).drop("is_test") for i in (0, 1))
    return rounded(fit_passengers(train, "passenger_id", "survived").transform(test))


def gaussian_detection(train: DataFrame, validation: DataFrame, test: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Fit a normal distribution on ``train``, choose the threshold on ``validation``, score ``test``.

    Columns that add no rank are left out first. Works on log densities; one row comes back.
    """
    kept = scale.independent_columns(train, cols)
    density = anomaly.fit_gaussian(train, kept).log_density()
    best = metrics.threshold_sweep(validation.withColumn("__p", density), label, "__p").first()
    if best is None:
        raise ValueError("no threshold separates the validation rows")
    scored = metrics.apply_threshold(test.withColumn("__p", density), label, "__p", best["epsilon"])
    return scored.withColumn("epsilon", F.lit(best["epsilon"]))


@query(
    "sensor_gaussian_f1",
    f"""with x as (select *, row_number() over (order by row_key) - 1 as i, (select count(*) // 2 from lineitem) as h from
    (select row_key, s1 / 10 as s1, s2 / 10000 as s2, att_flag from sensor_row)),
    g as (select avg(s1) as m1, avg(s2) as m2, var_samp(s1) as a, var_samp(s2) as d, covar_samp(s1, s2) as b from x where i <= h),
    p as (select att_flag as y, i, h, -0.5 * (2 * ln(2 * pi()) + ln(a * d - b * b) + (d * (s1 - m1) * (s1 - m1) - 2 * b * (s1 - m1) * (s2 - m2) + a * (s2 - m2) * (s2 - m2)) / (a * d - b * b)) as p from x, g),
    v as (select y, p, min(p) over () as lo, (max(p) over () - min(p) over ()) / 1000 as step from p where i >= h),
    s as (select j, min(lo) + j * min(step) as epsilon, count(*) filter (y = 1 and p < lo + j * step) as tp, count(*) filter (y = 0 and p < lo + j * step) as fp,
    count(*) filter (y = 1 and p >= lo + j * step) as fn from v, range(1000) r(j) group by j),
    e as (select epsilon from s where tp > 0 order by 2 * tp / (2 * tp + fp + fn) desc, j limit 1),
    c as (select epsilon, count(*) filter (y = 1 and p < epsilon) as tp, count(*) filter (y = 0 and p >= epsilon) as tn, count(*) filter (y = 0 and p < epsilon) as fp,
    count(*) filter (y = 1 and p >= epsilon) as fn from p, e group by 1)
    select tp, tn, fp, fn, {R('tp / (tp + fp)')} as precision, {R('tp / (tp + fn)')} as recall, {R('2 * tp / (2 * tp + fp + fn)')} as f1, {R('epsilon')} as epsilon from c""",
)
def sensor_gaussian_f1(t: Tables) -> DataFrame:
    data = t.sensor_row.select("row_key", (F.col("s1") / 10).alias("s1"), (F.col("s1") / 5).alias("copy"), (F.col("s2") / 10000).alias("s2"), "att_flag")
    train, validation = rows.split_at(data, ["row_key"], data.count() // 2)
    return rounded(gaussian_detection(train, validation, data, ["s1", "copy", "s2"], "att_flag"))



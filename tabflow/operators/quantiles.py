"""Exact quantiles whose memory does not grow with the data.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. It is used
for groups of proven size only. Larger ones are narrowed with a sketch: the sketch gives a
bracket around the wanted rank, plain counts prove that the rank lies inside, and only rows of
the bracket are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.session import LOOKUP_ROWS

# Rows of one group, or of a whole column, that the built-in exact percentile may keep.
SMALL = 100_000
# Distinct values that may come to the driver at the end of a narrowing search.
FINAL = 20_000
# Rows inside all brackets up to which their distinct values are fetched in one go.
_FETCH_ROWS = 50_000_000
_SKETCH = 20_000


def find_rank(df: DataFrame, value: str, rank: int, small: int = FINAL, bracket: tuple | None = None):
    """Value at zero-based ``rank`` in ascending order, the rows below it and the rows equal to it.

    NULL and NaN are not counted. ``bracket`` may name borders the value is expected between.
    """
    rows = df.select(value).na.drop()
    v = F.col(value)
    n, passed = rows.count(), 0
    while True:
        if n <= small:
            for item in rows.groupBy(value).count().orderBy(value).collect():
                if rank < item["count"]:
                    return item[value], passed, item["count"]
                rank -= item["count"]
                passed += item["count"]
            raise ValueError("rank is outside the column")
        if bracket is None:
            slack = 4 / _SKETCH
            probs = [max(0.0, rank / n - slack), min(1.0, rank / n + slack)]
            bracket = rows.agg(F.percentile_approx(v, probs, _SKETCH)).first()[0]
        low, high = bracket
        bracket = None
        below, upto = rows.agg(F.count(F.when(v < F.lit(low), 1)), F.count(F.when(v <= F.lit(high), 1))).first()
        if below <= rank < upto:
            if low == high:
                return low, passed + below, upto - below
            rows = rows.filter((v >= F.lit(low)) & (v <= F.lit(high)))
            if upto - below == n:
                # The bracket holds every row: its borders are the least and the largest value. They are settled by
                # their counts, and the search goes on strictly between them, so it always gets smaller.
                lows, highs = rows.agg(F.count(F.when(v == F.lit(low), 1)), F.count(F.when(v == F.lit(high), 1))).first()
                if rank < lows:
                    return low, passed, lows
                if rank >= n - highs:
                    return high, passed + n - highs, highs
                rows, n, below = rows.filter((v > F.lit(low)) & (v < F.lit(high))), n - lows - highs, lows
            else:
                n = upto - below
        elif rank < below:
            rows, n, below = rows.filter(v < F.lit(low)), below, 0
        else:
            rows, n, below = rows.filter(v > F.lit(high)), n - upto, upto
        rank -= below
        passed += below


def kth_smallest(df: DataFrame, value: str, rank: int, small: int = FINAL):
    """The value at zero-based ``rank`` in ascending order; NULL and NaN are not counted."""
    return find_rank(df, value, rank, small)[0]


def exact_quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float], small: int = SMALL) -> dict[str, list]:
    """Linearly interpolated quantiles of whole columns, ``{column: [value per probability]}``.

    Three passes whatever the number of columns: sketches give the brackets, counts check them,
    and the few values inside are fetched. A rank its bracket missed, or one with too many values
    left, is searched for on its own. NULL and NaN are not counted, at any size; a column without other values has None.
    """
    slack = 4 / _SKETCH
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in dict.fromkeys(values)])
    wanted = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    seen = df.agg(*[F.struct(F.count(c), F.percentile_approx(F.col(c).cast("double"), wanted, _SKETCH)).alias(c) for c in values]).first()
    counts = {c: seen[c][0] for c in values}
    if max(counts.values()) <= small:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in values]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in values}

    full = [c for c in values if counts[c]]
    brackets = {(c, i): tuple(seen[c][1][2 * i : 2 * i + 2]) for c in full for i in range(len(probs))}
    names = {k: f"__b{n}" for n, k in enumerate(brackets)}
    sides = [
        F.struct(F.count(F.when(F.col(c) < F.lit(low), 1)), F.count(F.when(F.col(c) <= F.lit(high), 1))).alias(names[c, i])
        for (c, i), (low, high) in brackets.items()
    ]
    sizes = df.agg(*sides).first()
    inside = _fetch(df, full, brackets) if sum(s[1] - s[0] for s in sizes) <= _FETCH_ROWS else {}

    def at(c: str, i: int, rank: int) -> float:
        below, upto = sizes[names[c, i]]
        low, high = brackets[c, i]
        if below <= rank < upto and low == high:
            return low
        if c in inside and below <= rank < upto:
            for v, n in inside[c]:
                if low <= v <= high:
                    below += n
                    if rank < below:
                        return v
        return float(kth_smallest(df, c, rank, min(small, FINAL)))

    out: dict[str, list] = {}
    for c in values:
        out[c] = []
        for i, p in enumerate(probs):
            if not counts[c]:
                out[c].append(None)
                continue
            place = p * (counts[c] - 1)
            share = place - math.floor(place)
            out[c].append((1 - share) * at(c, i, math.floor(place)) + share * at(c, i, math.ceil(place)))
    return out


def _fetch(df: DataFrame, cols: Sequence[str], brackets: dict) -> dict[str, list[tuple[float, int]]]:
    """Sorted ``(value, count)`` pairs of each column that lie in one of its brackets; none if there are too many."""
    cells, any_hit = [], F.lit(False)
    for n, c in enumerate(cols):
        hit = F.lit(False)
        for (name, _), (low, high) in brackets.items():
            if name == c:
                hit = hit | F.col(c).between(F.lit(low), F.lit(high))
        any_hit = any_hit | hit
        cells.append(F.struct(F.lit(n).alias("n"), F.when(hit, F.col(c).cast("double")).alias("v")))
    kept = df.filter(any_hit).select(F.explode(F.array(*cells)).alias("x")).select("x.*").na.drop()
    out: dict[str, list[tuple[float, int]]] = {c: [] for c in cols}
    most = FINAL * len(brackets)
    found = kept.groupBy("n", "v").count().limit(most + 1).collect()
    if len(found) > most:
        return {}
    for n, v, count in sorted(found):
        out[cols[n]].append((v, count))
    return out


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", hot_rows: int = SMALL) -> DataFrame:
    """Exact median per group.

    Groups above ``hot_rows`` rows are found by a pre-aggregated count. There are at most
    ``n / hot_rows`` of them; they take the bracket way, all others the built-in aggregate.
    """
    keys = list(keys)
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.filter(F.col("__n") > F.lit(hot_rows))
    median = F.percentile(value, 0.5).alias(name)
    hot_keys = hot.select(*keys)
    found = hot_keys.limit(LOOKUP_ROWS + 1).collect()
    if not found:
        return rows.groupBy(*keys).agg(median)
    few = len(found) <= LOOKUP_ROWS
    if few:
        hot_keys = F.broadcast(df.sparkSession.createDataFrame(found, hot_keys.schema))
    cold = rows.join(hot_keys, keys, "left_anti").groupBy(*keys).agg(median)
    return cold.unionByName(_bracket_median(rows.join(hot_keys, keys, "left_semi"), keys, value, name, few))


def _bracket_median(rows: DataFrame, keys: list[str], value: str, name: str, few: bool) -> DataFrame:
    slack = 4 / _SKETCH
    sketch = F.percentile_approx(value, [0.5 - slack, 0.5 + slack], _SKETCH)
    brackets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), sketch.alias("__b"))
    brackets = brackets.select(*keys, "__n", F.col("__b")[0].alias("__low"), F.col("__b")[1].alias("__high"))
    if few:
        brackets = F.broadcast(brackets)
    placed = rows.join(brackets, keys)
    v = F.col(value)
    # Equal values collapse before the per-group order is needed; values outside the bracket
    # collapse to one row per side.
    side = F.when(v < F.col("__low"), F.lit(-1)).when(v > F.col("__high"), F.lit(1)).otherwise(F.lit(0))
    kept = F.when(side == 0, v)
    tally = placed.groupBy(*keys, "__n", side.alias("__side"), kept.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*keys).orderBy("__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = tally.withColumn("__upto", F.sum("__c").over(order))
    first = F.floor((F.col("__n") - 1) / F.lit(2))
    second = F.ceil((F.col("__n") - 1) / F.lit(2))

    def holds(rank):
        return (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)

    middle = (F.max(F.when(holds(first), F.col("__v"))) + F.max(F.when(holds(second), F.col("__v")))) / 2.0
    # The sketch's rank error is at most n / accuracy, a quarter of the slack on either side; a
    # bracket that missed the middle all the same must not turn into a silent NULL.
    missed = F.raise_error(F.lit("median bracket missed its rank")).cast("double")
    return upto.groupBy(*keys).agg(F.coalesce(middle, missed).alias(name))

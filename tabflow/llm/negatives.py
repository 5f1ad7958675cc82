"""Hard negatives: rows of another label that score a little less than a positive, found by angular triangle filtering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.streams import block_streams, vectors
from tabflow.llm.vectors import _choose_pivots, _piece_of, list_matrix
from tabflow.session import cut_lineage

# Vectors that reference directions are chosen from, directions, and hash buckets of labels.
SAMPLE, DIRECTIONS, BUCKETS = 2048, 8, 16
# Most rows and anchors of a block, and anchors bounded at once.
PIECE_ROWS, VISIT_ROWS, TILE = 16_384, 65_536, 64
# More than single precision moves the cosine of a sum or difference of two stored angles.
SLACK = np.float32(1e-5)
# Squared length from which scores may leave 64 bits.
MOST_SQUARE = 2.0**62


def score_bounds(a: np.ndarray, x: np.ndarray, size_a: np.ndarray, size_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every pair, from angles to the same directions (rows of ``a`` and ``x``) and lengths.

    The angle of a pair is at least the difference of their angles to a direction, and at most their sum, or what that lacks of a full turn.
    """
    least = np.zeros((len(a), len(x)), np.float32)
    most = np.full((len(a), len(x)), np.pi, np.float32)
    for r in range(a.shape[1]):
        p, q = a[:, r, None], x[None, :, r]
        np.maximum(least, np.abs(p - q), out=least)
        total = p + q
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    size = size_a.astype(np.float32)[:, None] * size_x.astype(np.float32)[None, :]
    return size * (np.cos(most) - SLACK), size * (np.cos(least) + SLACK)


def cell_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray, size_a: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for all rows of a cell, whose angles lie between ``low`` and ``high`` and whose lengths are ``size`` at most."""
    a, low, high = a[:, None, :].astype(float), low[None].astype(float), high[None].astype(float)
    least = np.maximum(0, np.maximum(low - a, a - high)).max(axis=2)
    small, large = a + low, a + high
    most = np.where(large <= np.pi, large, np.where(small >= np.pi, 2 * np.pi - small, np.pi)).min(axis=2)
    both = size_a[:, None] * size[None, :]
    slack = 2 * float(SLACK)
    return both * (np.minimum(np.cos(most), 0) - slack), both * (np.maximum(np.cos(least), 0) + slack)


class Rows:
    """Rows of a block as arrays."""

    def __init__(self, table: pa.Table, dims: int, directions: int):
        self.row, self.key, self.label = (table.column(c).to_numpy() for c in ("row", "key", "label"))
        self.size = table.column("size").to_numpy()
        self.angles = np.stack([table.column(f"a{j}").to_numpy() for j in range(directions)], axis=1)
        parts = table.column("whole").to_pylist()
        if all(len(p) == 4 * dims for p in parts):
            self.whole = vectors(table.column("whole"), "<i4")
        else:
            self.whole = np.zeros((len(parts), dims), np.int32)
            for i, p in enumerate(parts):
                self.whole[i, : len(p) // 4] = np.frombuffer(p, "<i4")
        # Sums of products below 2 ** 53 are exact in doubles, others are taken as integers.
        self.double = self.whole.astype(float)

    def scores(self, other: Rows, at: slice, wanted: np.ndarray) -> np.ndarray:
        """Integer inner products of ``other[at]`` with the rows, where ``wanted``."""
        exact = float(self.size.max()) * float(other.size[at].max()) < 2.0**52
        mine, theirs = (self.double, other.double[at]) if exact else (self.whole.astype(np.int64), other.whole[at].astype(np.int64))
        if exact and wanted.mean() > 0.1:
            return (theirs @ mine.T).astype(np.int64)
        out = np.zeros(wanted.shape, np.int64)
        who, what = np.nonzero(wanted)
        for i in range(0, len(who), 65_536):
            p, q = who[i : i + 65_536], what[i : i + 65_536]
            out[p, q] = np.einsum("ij,ij->i", theirs[p], mine[q]).astype(np.int64)
        return out


def _first(group: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """The k rows of each group with the highest score; ties by smaller key."""
    order = np.lexsort((key, -score, group))
    g = group[order]
    start = np.concatenate([[0], np.nonzero(g[1:] != g[:-1])[0] + 1]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.concatenate([start, [len(g)]])))
    return order[place < k]


def hard_negatives(
    rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
    percent: int = 80, scale: int = 256, piece_rows: int = PIECE_ROWS, visit_rows: int = VISIT_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives, the highest-scoring rows of another label with ``percent`` to 100 per cent of the positive's score.

    A component x becomes ``floor(scale * x)``; a score is the integer inner product with the anchor. Rows where ``anchors`` is true are anchors. An
    anchor's positives are the ``positives`` other rows of its label with the highest scores, its negatives the first ``negatives`` rows of other
    labels with ``percent * positive_score <= 100 * negative_score <= 100 * positive_score``. Ties go to the smaller key.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, one row per negative.

    Every row stores its length and its angles to a few directions, chosen from a bounded sample. They bound the score of a pair
    from both sides, wider than rounding can move it. Rows lie in cells (a hash bucket of their label, their nearest direction), cut into
    pieces of ``piece_rows``; an anchor visits the cells of its own label for positives, then those whose bounds overlap a window of its
    positives. In a block, pairs whose bounds overlap a window (for positives: reach the least of the best lower bounds) are scored.
    Anchors are rows like others; none passes through the driver. All pairs of an anchor and a row that bounds don't part are scored,
    which is most pairs where vectors lie without order.

    Rows with a null key, label or vector, an empty vector, or a null or non-finite component take no part, nor do those whose integer vector has a
    squared length of 2 ** 62 or more: their scores don't fit in 64 bits. A shorter vector counts as if it ended in zeros. Rows of equal keys are rows of
    their own, so an anchor may have one of its own key as positive; repeated anchors repeat their results. Keys and labels are integers. Other columns are ignored.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType
    cast = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = list_matrix(batch.column("vector"))
            whole = np.floor(np.where(good[:, None], x, 0.0) * float(scale))
            with np.errstate(over="ignore"):
                square = (whole * whole).sum(axis=1)
            good &= square < MOST_SQUARE
            count = batch.column("vector").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            whole = np.where(good[:, None], whole, 0).astype("<i4")
            held = pa.array([whole[i, : count[i]].tobytes() if g else None for i, g in enumerate(good.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "label", "anchor")), held, pa.array(np.sqrt(np.where(good, square, 0.0)))], ["key", "label", "anchor", "whole", "size"])

    sized = cast.filter("key is not null and label is not null and vector is not null").mapInArrow(integers, "key long, label long, anchor boolean, whole binary, size double")
    sized = cut_lineage(sized.filter("whole is not null").withColumn("row", F.monotonically_increasing_id()))
    drawn = sized.select("whole", F.xxhash64("key", "whole").alias("order")).orderBy("order").limit(SAMPLE).select("whole").toArrow().column("whole").to_pylist()
    dims = (sized.agg(F.max(F.octet_length("whole")).alias("b")).first().b or 0) // 4
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not drawn:
        return spark.createDataFrame([], schema).withColumn("anchor_id", F.col("anchor_id").cast(kind)).withColumn("positive_id", F.col("positive_id").cast(kind)).withColumn("negative_id", F.col("negative_id").cast(kind))

    def unit(parts: list[bytes]) -> np.ndarray:
        x = np.zeros((len(parts), dims))
        for i, p in enumerate(parts):
            x[i, : len(p) // 4] = np.frombuffer(p, "<i4")
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]

    directions = _choose_pivots(unit(drawn), DIRECTIONS, math.pi / 6)
    k = len(directions)
    names = [f"a{j}" for j in range(k)]
    angles = ", ".join(f"{a} float" for a in names)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.arccos(np.clip(unit(batch.column("whole").to_pylist()) @ directions.T, -1.0, 1.0)).astype(np.float32)
            cell = batch.column("bucket").to_numpy() * k + np.argmin(angle, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell, pa.int64()), *(pa.array(angle[:, j]) for j in range(k))], [*batch.schema.names[:-1], "cell", *names])

    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("long"))
    base = f"key long, label long, anchor boolean, whole binary, size double, row long, cell long, {angles}"
    lain = cut_lineage(bucketed.mapInArrow(placed, base))
    # One row for each bucket and direction at most.
    spans = [F.min(a).alias(f"low_{a}") for a in names] + [F.max(a).alias(f"high_{a}") for a in names]
    cells = lain.groupBy("cell").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"), *spans).collect()
    number = np.array([c.cell for c in cells], np.int64)
    pieces = np.array([-(-c.n // piece_rows) for c in cells], np.int64)
    size = np.array([c["size"] for c in cells])
    alone = np.array([[c.l0, c.l1] for c in cells], np.int64)
    low, high = (np.array([[c[f"{side}_{a}"] for a in names] for c in cells], np.float32) for side in ("low", "high"))
    per_cell = np.zeros(BUCKETS * k, np.int64)
    per_cell[number] = pieces
    chunks = max(1, -(-lain.filter("anchor").count() // visit_rows))
    shape = f"row long, key long, label long, whole binary, size double, {angles}, windows binary, cell long, piece long, chunk long, role int"
    own = ["row", "key", "label", "whole", "size", *names]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, row = batch.column("cell").to_numpy(), batch.column("row").to_numpy()
            for c in range(chunks):
                more = [batch.column("cell"), pa.array(_piece_of(row, per_cell[cell])), pa.array(np.full(len(row), c)), pa.array(np.zeros(len(row), np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in own), pa.nulls(len(row), pa.binary()), *more], [*own, "windows", "cell", "piece", "chunk", "role"])

    def visits(choose: Callable[[pa.RecordBatch], np.ndarray]) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    who, where = np.nonzero(choose(part))
                    times = pieces[where]
                    who, where = np.repeat(who, times), np.repeat(where, times)
                    piece = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                    chunk = _piece_of(part.column("row").to_numpy(), np.full(part.num_rows, chunks))[who]
                    for i in range(0, len(who), 8192):
                        some = slice(i, i + 8192)
                        take = pa.array(who[some])
                        more = [pa.array(number[where[some]]), pa.array(piece[some]), pa.array(chunk[some]), pa.array(np.ones(len(take), np.int32))]
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in (*own, "windows")), *more], [*own, "windows", "cell", "piece", "chunk", "role"])

        return scan

    def of_own_label(part: pa.RecordBatch) -> np.ndarray:
        return part.column("cell").to_numpy()[:, None] // k == number[None, :] // k

    def overlapping(part: pa.RecordBatch) -> np.ndarray:
        a = np.stack([part.column(c).to_numpy() for c in names], axis=1)
        least, most = cell_bounds(a, low, high, part.column("size").to_numpy(), size)
        score, label_ = _windows(part), part.column("label").to_numpy()[:, None]
        hit = np.zeros(least.shape, bool)
        for j in range(positives):
            hit |= (100 * most >= percent * score[:, j, None]) & (least <= score[:, j, None])
        return hit & ~((alone[None, :, 0] == label_) & (alone[None, :, 1] == label_))

    def _windows(table) -> np.ndarray:
        """Scores of each anchor's positives, filled up with NaN."""
        parts = [np.frombuffer(w, "<i8") for w in table.column("windows").to_pylist()]
        out = np.full((len(parts), positives), np.nan)
        for i, p in enumerate(parts):
            out[i, : len(p) // 3] = p[2::3]
        return out

    def nearest(table: pa.Table, visitors: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        mine = Rows(table, dims, k)
        for part in visitors:
            other = Rows(part, dims, k)
            for i in range(0, len(other.row), TILE):
                at = slice(i, i + TILE)
                fits = (other.label[at, None] == mine.label[None, :]) & (other.row[at, None] != mine.row[None, :])
                least, most = score_bounds(other.angles[at], mine.angles, other.size[at], mine.size)
                if fits.shape[1] > positives:
                    best = -np.partition(np.where(fits, -least, np.inf), positives - 1, axis=1)[:, positives - 1]
                    fits &= most >= best[:, None]
                score = mine.scores(other, at, fits)
                who, what = np.nonzero(fits)
                top = _first(who, score[who, what], mine.key[what], positives)
                who, what = who[top], what[top]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (other.row[at][who], mine.row[what], mine.key[what], score[who, what])], ["row", "positive", "positive_id", "score"])

    def inside(table: pa.Table, visitors: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        mine = Rows(table, dims, k)
        for part in visitors:
            other, border = Rows(part, dims, k), _windows(part)
            held = [np.frombuffer(w, "<i8") for w in part.column("windows").to_pylist()]
            for i in range(0, len(other.row), TILE):
                at = slice(i, i + TILE)
                least, most = score_bounds(other.angles[at], mine.angles, other.size[at], mine.size)
                fits = np.zeros(least.shape, bool)
                for j in range(positives):
                    fits |= (most >= np.float32(percent / 100) * border[at, j, None].astype(np.float32)) & (least <= border[at, j, None].astype(np.float32))
                fits &= other.label[at, None] != mine.label[None, :]
                if not fits.any():
                    continue
                score = mine.scores(other, at, fits)
                who, what = np.nonzero(fits)
                value = score[who, what]
                for j in range(positives):
                    upper = np.array([h[3 * j + 2] if len(h) > 3 * j else 0 for h in held[at]], np.int64)
                    some = ~np.isnan(border[at, j])
                    # Both sides of a window are compared without a product that could leave 64 bits.
                    lower = np.array([-(-percent * int(u) // 100) for u in upper.tolist()], np.int64)
                    good = np.nonzero(some[who] & (value >= lower[who]) & (value <= upper[who]))[0]
                    top = good[_first(who[good], value[good], mine.key[what[good]], negatives)]
                    p, q = who[top], what[top]
                    name = [np.array([h[3 * j + c] if len(h) > 3 * j else 0 for h in held[at]], np.int64)[p] for c in (0, 1)]
                    out = [other.row[at][p], other.key[at][p], *name, mine.key[q], upper[p], value[top]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row", "anchor_id", "positive", "positive_id", "negative_id", "positive_score", "negative_score"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [np.array([v for p in w for v in (p["positive"], p["positive_id"], p["score"])], "<i8").tobytes() for w in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.binary())], ["row", "windows"])

    def best(found: DataFrame, group: list[str], score: str, name: str, most: int) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.col(score).desc(), name)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    all_members = lain.mapInArrow(members, shape)
    asking = lain.filter("anchor").withColumn("windows", F.lit(None).cast("binary"))
    block = ["cell", "piece", "chunk"]
    first = block_streams(all_members.unionByName(asking.mapInArrow(visits(of_own_label), shape)), block, nearest, "row long, positive long, positive_id long, score long")
    kept = best(first, ["row"], "score", "positive_id", positives).groupBy("row").agg(F.collect_list(F.struct("positive", "positive_id", "score")).alias("found"))
    windows = cut_lineage(kept.mapInArrow(packed, "row long, windows binary"))
    asking = lain.filter("anchor").join(windows, "row")
    second = block_streams(
        all_members.unionByName(asking.mapInArrow(visits(overlapping), shape)), block, inside,
        "row long, anchor_id long, positive long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    ranked = best(second, ["row", "positive"], "negative_score", "negative_id", negatives)
    return ranked.select(*[F.col(c).cast(kind).alias(c) for c in ("anchor_id", "positive_id")], "rank", F.col("negative_id").cast(kind).alias("negative_id"), "positive_score", "negative_score")

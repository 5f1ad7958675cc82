"""Extremely randomised trees and second-order boosting, grown level by level from sums that tasks return.

Rows are packed into blocks once. A level is one or two scans of the blocks: each task answers with sums per tree and node, which are
added and judged by tree or node. A bounded amount of answers is sent to the driver; beyond that groups of a tree or node do the same
work and only splits reach the driver. Sums are whole numbers, so that no result depends on how rows lie in partitions, on the order of tasks
or on where they are added. Random draws are functions of the seed, the tree, the
path to the node and the feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.session import cut_lineage

SEED = 157
# Numbers that a scan of extra trees adds up for all its nodes; trees are dealt into scans of that size. A task holds those of one tree at a time.
SCAN_NUMBERS = 32_000_000
# Bytes of features that a task of extra trees holds at once, and those of them it sorts by node at once.
HELD_BYTES, UNIT_BYTES = 64 << 20, 4 << 20
# Blocks that every core should get where trees are shared out, so that cores end at about the same time.
CORE_BLOCKS = 4
# Groups of rows that are gone through at once.
_GROUPS = 1024
# Bytes that the tasks of a scan may answer with to the driver; more are added up in groups.
ANSWER_BYTES = 8 << 20
# Cells of the grid of bins up to which boosting adds up all rows of a cell first, which all trees treat alike.
MOST_CELLS = 1 << 20
# Rounds of boosting whose trees are walked again before margins are written; more where the rows are sums of cells.
WRITE_ROUNDS, CELL_WRITE_ROUNDS = 10, 40
# Cells that a task of a scan of them should get.
TASK_CELLS = 4096
_F32 = float(np.finfo(np.float32).max)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of unsigned 64-bit numbers (splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def draws(keys: np.ndarray, features: int, salt: int) -> np.ndarray:
    """Uniform draws in [0, 1) for every key and feature."""
    with np.errstate(over="ignore"):
        cells = _mixed(keys)[:, None] ^ _mixed(np.arange(features, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(salt))[None, :]
    return (_mixed(cells) >> np.uint64(11)).astype(float) / float(1 << 53)


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(np.asarray(keys, np.uint64) * np.uint64(2) + np.uint64(side))


def _numbers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lowest(x: np.ndarray) -> np.ndarray:
    """NaN as the smallest number."""
    return np.where(np.isnan(x), np.float32(-_F32), x)


def _as_array(df: DataFrame, features: str) -> Column:
    if isinstance(df.schema[features].dataType, VectorUDT):
        return F.when(F.col(features).isNotNull(), vector_to_array(features))
    return F.col(features).cast("array<double>")


def packed_rows(df: DataFrame, features: str, columns: Sequence[str]) -> DataFrame:
    """Blocks of rows: features as single-precision numbers and each column as doubles, row after row. Rows with a null are left out."""
    rows = df.select(_as_array(df, features).alias("x"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.clip(_numbers(batch.column("x")), -_F32, _F32).astype("<f4")
                held = [pa.array([batch.column(f"c{i}").to_numpy().astype("<f8").tobytes()], pa.binary()) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int64()), *held], ["x", "width", *(f"c{i}" for i in range(len(columns)))])

    blocks = rows.mapInArrow(pack, "x binary, width long, " + ", ".join(f"c{i} binary" for i in range(len(columns))))
    return cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))


def _added(blocks: DataFrame, scan, answer: str, key: str, add, schema: str, most_bytes: int) -> list[dict]:
    """``scan`` over all blocks, and ``add`` over the answers of equal ``key``; ``most_bytes`` is what all tasks answer at most."""
    answers = blocks.mapInArrow(scan, answer)
    if most_bytes > ANSWER_BYTES:
        return sorted(answers.groupBy(key).applyInArrow(add, schema).toArrow().to_pylist(), key=lambda r: r[key])
    held = answers.toArrow()
    at = held.column(key).to_numpy()
    order = np.argsort(at, kind="stable")
    held, at = held.take(pa.array(order)), at[order]
    edge = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1).tolist(), len(at)] if len(at) else [0]
    return [row for a, b in zip(edge[:-1], edge[1:], strict=True) for row in add(held.slice(a, b - a)).to_pylist()]


@dataclass
class Paths:
    """What a walk down some trees needs: a leaf is its own child, and nothing lies above its cut. ``node`` holds the numbers in all trees."""

    node: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    def walked(self, x: np.ndarray, tree: int, steps: int) -> np.ndarray:
        """Where the rows of ``x`` are after ``steps`` steps from the root of the tree that stands at place ``tree``."""
        at = np.full(len(x), tree, np.intp)
        flat, base = x.reshape(-1), np.arange(len(x)) * x.shape[1]
        for _ in range(steps):
            # All places exist; "clip" only spares a check of each.
            cell = base + self.feature.take(at, mode="clip")
            at = self.child.take(at, mode="clip") + (flat.take(cell, mode="clip") > self.cut.take(at, mode="clip"))
        return at


@dataclass
class Trees:
    """Nodes of many trees: feature, cut (larger values go right), left child (the right one follows; -1 for a leaf), values."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, tree: int, steps: int) -> np.ndarray:
        """The node of every row of ``x`` after ``steps`` steps from the root of a tree, or its leaf."""
        node = np.full(len(x), self.roots[tree])
        every = np.arange(len(x))
        for _ in range(steps):
            down = self.left[node]
            inner = down >= 0
            if not inner.any():
                break
            node = np.where(inner, down + (x[every, self.feature[node]] > self.cut[node]), node)
        return node

    def paths(self, trees: np.ndarray) -> Paths:
        """The nodes of some trees, numbered anew, the roots first."""
        part = [self.roots[trees]]
        while len(part[-1]):
            down = self.left[part[-1]]
            down = down[down >= 0]
            part.append(np.stack([down, down + 1], axis=1).ravel())
        node = np.concatenate(part)
        place = np.full(len(self.left), -1, np.int32)
        place[node] = np.arange(len(node), dtype=np.int32)
        leaf = self.left[node] < 0
        child = np.where(leaf, np.arange(len(node)), place[self.left[node]]).astype(np.int32)
        return Paths(node, self.feature[node].astype(np.int32), np.where(leaf, np.float32(np.inf), self.cut[node]).astype(np.float32), child)

    def grown(self, parent: np.ndarray, feature: np.ndarray, cut: np.ndarray, left_value: np.ndarray, right_value: np.ndarray) -> np.ndarray:
        """Split leaves; returns the numbers of their left children."""
        n, base = len(parent), len(self.left)
        left = base + 2 * np.arange(n)
        self.feature[parent], self.cut[parent], self.left[parent] = feature, cut, left
        self.feature = np.concatenate([self.feature, np.zeros(2 * n, np.int32)])
        self.cut = np.concatenate([self.cut, np.zeros(2 * n, self.cut.dtype)])
        self.left = np.concatenate([self.left, np.full(2 * n, -1, np.int64)])
        value = np.empty((2 * n, *self.value.shape[1:]), self.value.dtype)
        value[0::2], value[1::2] = left_value, right_value
        self.value = np.concatenate([self.value, value])
        return left


def _no_trees(count: int, width: int, cut_type) -> Trees:
    return Trees(np.arange(count), np.zeros(count, np.int32), np.zeros(count, cut_type), np.full(count, -1, np.int64), np.zeros((count, width)))


@dataclass(frozen=True)
class Forest:
    """Extra trees: a probability is the mean share of the class in the leaves a row falls into."""

    trees: Trees
    depth: int
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (array by class) and ``prediction`` (most probable class, the first on a tie); null features give null."""
        trees, depth = len(self.trees.roots), self.depth
        paths = self.trees.paths(np.arange(trees))
        value = self.trees.value[paths.node].astype(np.int64 if self.trees.value.max(initial=0) >= 1 << 31 else np.int32)
        paths = replace(paths, node=None)

        @F.pandas_udf("array<double>")
        def share(s: pd.Series) -> pd.Series:
            some = s.notna().to_numpy()
            out = pd.Series([None] * len(s), s.index, object)
            if some.any():
                x = _lowest(np.clip(np.stack(s[some].to_numpy()).astype(float), -_F32, _F32).astype(np.float32))
                total = np.zeros((len(x), value.shape[1]))
                for t in range(trees):
                    total += _shares(value.take(paths.walked(x, t, depth), axis=0))
                out[some] = pd.Series(list(total / trees), s.index[some])
            return out

        scored = df.withColumn("probability", share(_as_array(df, self.features)))
        return scored.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


@dataclass(frozen=True)
class Plan:
    """One tree: the fold it leaves out (-1: none), how many features a node draws, its depth, and its number among its like."""

    number: int
    subset: int
    depth: int
    fold: int = -1


def subset_size(subset: str | int | float, features: int) -> int:
    """``all``, ``sqrt``, ``log2``, a number, or a share of the features."""
    if subset == "all":
        return features
    if subset in ("sqrt", "log2"):
        return max(1, int(math.sqrt(features) if subset == "sqrt" else math.log2(features)))
    return max(1, min(features, int(subset * features) if isinstance(subset, float) else int(subset)))


def _poisson(block: int, rows: int, tree: int, seed: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree: a Poisson(1) number of its place."""
    with np.errstate(over="ignore"):
        key = _mixed(np.arange(rows, dtype=np.uint64) + _mixed(np.uint64(block) ^ _mixed(np.uint64(tree) + _mixed(np.uint64(seed)))))
    u = (key >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), u, "right")


def grow_extra_trees(blocks: DataFrame, plans: Sequence[Plan], classes: int, features: int, bootstrap: bool = False, seed: int = SEED, scan_numbers: int = SCAN_NUMBERS) -> Trees:
    """All trees of ``plans`` over packed rows with the class in ``c0`` and, if a plan names a fold, the fold in ``c1``.

    A level takes two scans: the first finds the least and largest value of every node and feature, between which a cut is drawn; the second
    counts the classes to the right of it. The cut with the purest sides (Gini) stays, of equal ones that of the first feature. A node draws
    ``subset`` features among those that vary in it. A NaN is the smallest number. Levels of more than ``scan_numbers`` numbers take several scans.
    Nodes of one class are not looked at again.
    """
    forest = _no_trees(len(plans), classes, np.float32)
    keys = _mixed(np.array([p.number for p in plans], np.uint64) + _mixed(np.uint64(seed)))
    active = np.arange(len(plans))
    owner = np.arange(len(plans))
    level = 0
    depths = np.array([p.depth for p in plans])
    blocks, tasks, shares = _dealt(blocks, len(plans))
    while len(active):
        keep = depths[owner] > level
        active, owner, keys = active[keep], owner[keep], keys[keep]
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        per_scan = max(1, scan_numbers // (features * max(2, classes)))
        at = 0
        while at < len(active):
            stop = min(len(active), at + per_scan)
            # A scan holds whole trees, or one.
            while stop < len(active) and stop > at + 1 and owner[stop] == owner[stop - 1] and owner[stop - 1] != owner[at]:
                stop -= 1
            while stop < len(active) and owner[stop] == owner[stop - 1] and owner[stop - 1] == owner[at]:
                stop += 1
            new.append(_split_nodes(blocks, forest, plans, active[at:stop], owner[at:stop], keys[at:stop], level, classes, features, bootstrap, seed, tasks, shares))
            at = stop
        active, owner, keys = (np.concatenate([n[i] for n in new]) if new else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((active, owner))
        active, owner, keys = active[order], owner[order], keys[order]
        level += 1
    return forest


def _dealt(blocks: DataFrame, trees: int) -> tuple[DataFrame, int, int]:
    """Blocks dealt evenly to the cores, the number of tasks that read them, and into how many shares trees are dealt where blocks are few."""
    count, cores = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(trees, -(-CORE_BLOCKS * cores // max(1, count))))
    cells = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    # More than a few blocks a core lie in tasks of their own already.
    if shares > 1 or count < 2 * CORE_BLOCKS * cores:
        cells = cut_lineage(cells.repartitionByRange(cores, "share", "block").sortWithinPartitions("share", "block"))
    return cells, max(1, cells.rdd.getNumPartitions()), shares


@dataclass
class _Unit:
    """Rows that are sorted by node at once: features and one more row below all cuts, classes, folds, and the blocks they came in."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray | None
    blocks: list[tuple[int, int]]


def _held(batches: Iterator[pa.RecordBatch], folds: bool) -> Iterator[tuple[int, list[_Unit]]]:
    """Units of at most ``HELD_BYTES`` together (or one block), all of one share."""
    share, held, unit, bytes_ = None, [], [], 0

    def joined(parts: list) -> _Unit:
        width = parts[0][0].shape[1]
        x = np.concatenate([*(p[0] for p in parts), np.full((1, width), -np.inf, np.float32)])
        return _Unit(x, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]) if folds else None, [p[3] for p in parts])

    for batch in batches:
        for i in range(batch.num_rows):
            here = batch.column("share")[i].as_py()
            x = _lowest(np.frombuffer(batch.column("x")[i].as_buffer(), "<f4").reshape(-1, batch.column("width")[i].as_py()))
            y = np.frombuffer(batch.column("c0")[i].as_buffer(), "<f8").astype(np.int64)
            fold = np.frombuffer(batch.column("c1")[i].as_buffer(), "<f8").astype(np.int64) if folds else None
            full = share is not None and (here != share or bytes_ + x.nbytes > HELD_BYTES)
            if unit and (full or sum(p[0].nbytes for p in unit) + x.nbytes > UNIT_BYTES):
                held.append(joined(unit))
                unit = []
            if full:
                yield share, held
                held, bytes_ = [], 0
            share = here
            unit.append((x, y, fold, (batch.column("block")[i].as_py(), len(x))))
            bytes_ += x.nbytes
    if unit:
        held.append(joined(unit))
    if held:
        yield share, held


def _answers(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of answers as batches of some size."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size > most:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _planes(size: np.ndarray, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of ``size`` rows each in groups of equal width: the rows as one plane for each place in a group, and the groups of a segment.

    ``place`` are the rows, segment after segment; what a group lacks is filled with ``first`` of its segment.
    """
    mean = len(place) / len(size)
    width = 8 if mean >= 16 else 4 if mean >= 8 else 2 if mean >= 4 else 1
    groups = -(-size // width)
    at = np.repeat(first, groups * width)
    start = np.cumsum(groups) - groups
    at[np.arange(len(place)) + np.repeat(start * width - (np.cumsum(size) - size), size)] = place
    return np.ascontiguousarray(at.reshape(-1, width).T), groups


def _reduced(op: np.ufunc, values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``op`` over segments of rows."""
    while len(values) >= 16 * len(size):
        start = np.cumsum(size) - size
        at, size = _planes(size, start, np.arange(len(values)))
        out = values.take(at[0], axis=0)
        for plane in at[1:]:
            op(out, values.take(plane, axis=0), out=out)
        values = out
    return op.reduceat(values, np.cumsum(size) - size, axis=0)


def _ranges(x: np.ndarray, order: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values of segments of the rows ``order``."""
    at, groups = _planes(size, order[np.cumsum(size) - size], order)
    low, high = (np.empty((at.shape[1], x.shape[1]), np.float32) for _ in range(2))
    held = np.empty((min(_GROUPS, at.shape[1]), x.shape[1]), np.float32)
    for a in range(0, at.shape[1], _GROUPS):
        least, most = low[a : a + _GROUPS], high[a : a + _GROUPS]
        x.take(at[0, a : a + _GROUPS], axis=0, out=least, mode="clip")
        most[:] = least
        for plane in at[1:]:
            values = x.take(plane[a : a + _GROUPS], axis=0, out=held[: len(least)], mode="clip")
            np.minimum(least, values, out=least)
            np.maximum(most, values, out=most)
    return _reduced(np.minimum, low, groups), _reduced(np.maximum, high, groups)


def _above(x: np.ndarray, order: np.ndarray, size: np.ndarray, cuts: np.ndarray, node: np.ndarray) -> np.ndarray:
    """How many rows of each segment lie above the cut of its node, by feature. The last row of ``x`` lies above none."""
    at, groups = _planes(size, np.full(len(size), len(x) - 1), order)
    features = x.shape[1]
    # Eight counts below 256 are added as one number.
    count = np.zeros((at.shape[1], -(-features // 8) * 8), np.uint8)
    node = np.repeat(node, groups)
    held, more = np.empty((min(_GROUPS, len(node)), features), np.float32), np.empty((min(_GROUPS, len(node)), features), bool)
    for a in range(0, len(node), _GROUPS):
        cut, here = cuts.take(node[a : a + _GROUPS], axis=0), count[a : a + _GROUPS, :features]
        for plane in at:
            values = x.take(plane[a : a + _GROUPS], axis=0, out=held[: len(cut)], mode="clip")
            over = np.greater(values, cut, out=more[: len(cut)])
            np.add(here, over.view(np.uint8), out=here)
    most = 255 // len(at)
    parts = -(-groups // most)
    first = np.cumsum(parts) - parts
    start = np.repeat(np.cumsum(groups) - groups, parts) + most * (np.arange(parts.sum()) - np.repeat(first, parts))
    count = np.add.reduceat(count.view(np.uint64), start, axis=0).view(np.uint8)[:, :features]
    return count if len(parts) == len(count) else np.add.reduceat(count, first, axis=0, dtype=np.int64)


def _shares(value: np.ndarray) -> np.ndarray:
    """Class counts as shares."""
    return value / np.maximum(value.sum(axis=1, keepdims=True), 1)


def _split_nodes(blocks: DataFrame, forest: Trees, plans: Sequence[Plan], active: np.ndarray, owner: np.ndarray, keys: np.ndarray, level: int, classes: int, features: int, bootstrap: bool, seed: int, tasks: int, shares: int):
    """Split the nodes of some trees where that helps; returns their children, the trees and the keys of these."""
    names = np.unique(owner)
    first = {int(t): int(i) for t, i in zip(names, np.searchsorted(owner, names), strict=True)}
    count = {int(t): int(n) for t, n in zip(names, np.bincount(owner)[names], strict=True)}
    # Tasks get the nodes of these trees only.
    paths = forest.paths(names)
    slot = np.full(len(forest.left), -1, np.int32)
    slot[active] = np.arange(len(active)) - np.searchsorted(owner, owner)
    slot = slot[paths.node]
    paths = replace(paths, node=None)
    folds = any(p.fold >= 0 for p in plans)
    fold_of = {int(t): plans[t].fold for t in names}
    number_of = {int(t): plans[t].number for t in names}
    root = {int(t): i for i, t in enumerate(names)}

    def sorted_rows(t: int, unit: _Unit) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a tree in order of node and class, and ``node * classes + class`` of these."""
        key = slot.take(paths.walked(unit.x[:-1], root[t], level)) * np.int64(classes) + unit.y
        # Negative where the row's node is not among those to split.
        good = key >= 0
        if fold_of[t] >= 0:
            good &= unit.fold != fold_of[t]
        at = np.nonzero(good)[0]
        if bootstrap:
            weight = np.concatenate([_poisson(block, rows, number_of[t], seed) for block, rows in unit.blocks])
            at = np.repeat(at, weight[at])
        key = key[at]
        order = np.argsort(key.astype(np.uint16) if count[t] * classes <= 1 << 16 else key, kind="stable")
        return at[order], key[order]

    def segments(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.concatenate([[0], np.nonzero(name[1:] != name[:-1])[0] + 1])
        return name[edge], np.diff(np.append(edge, len(name)))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for share, units in _held(batches, folds):
                for t, n in count.items():
                    if t % shares != share:
                        continue
                    low, high = np.full((n, features), np.inf, np.float32), np.full((n, features), -np.inf, np.float32)
                    total = np.zeros(n * classes, np.int64)
                    for unit in units:
                        order, key = sorted_rows(t, unit)
                        if len(order):
                            total += np.bincount(key, minlength=n * classes)
                            here, size = segments(key // classes)
                            least, most = _ranges(unit.x, order, size)
                            low[here] = np.minimum(low[here], least)
                            high[here] = np.maximum(high[here], most)
                    total = total.reshape(n, classes)
                    some = np.nonzero(total.any(axis=1))[0]
                    if len(some):
                        yield {"tree": t, "node": some.astype("<i4").tobytes(), "low": low[some].tobytes(), "high": high[some].tobytes(), "total": total[some].tobytes()}

        yield from _answers(rows(), pa.schema([("tree", pa.int64()), *((c, pa.binary()) for c in ("node", "low", "high", "total"))]))

    def drawn(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        n = count[t]
        low, high = np.full((n, features), np.inf, np.float32), np.full((n, features), -np.inf, np.float32)
        total = np.zeros((n, classes), np.int64)
        for r in table.to_pylist():
            here = np.frombuffer(r["node"], "<i4")
            low[here] = np.minimum(low[here], np.frombuffer(r["low"], np.float32).reshape(-1, features))
            high[here] = np.maximum(high[here], np.frombuffer(r["high"], np.float32).reshape(-1, features))
            total[here] += np.frombuffer(r["total"], np.int64).reshape(-1, classes)
        key = keys[first[t] : first[t] + n]
        vary = (high > low) & ((total > 0).sum(axis=1) > 1)[:, None]
        # Of the features that vary, those with the smallest draws.
        rank = np.argsort(np.argsort(np.where(vary, draws(key, features, 1), 2.0), axis=1, kind="stable"), axis=1, kind="stable")
        u = draws(key, features, 2)
        with np.errstate(over="ignore", invalid="ignore"):
            cut = (low.astype(float) + u * (high.astype(float) - low.astype(float))).astype(np.float32)
        cut = np.where(cut >= high, low, cut)
        cut[~(vary & (rank < plans[t].subset))] = np.nan
        return pa.table({"tree": [t], "cut": pa.array([cut.astype("<f4").tobytes()], pa.binary()), "total": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    cuts, totals = {}, {}
    for r in _added(blocks, ranges, "tree long, node binary, low binary, high binary, total binary", "tree", drawn, "tree long, cut binary, total binary", tasks * len(active) * 8 * (features + classes)):
        t = r["tree"]
        cuts[t], totals[t] = np.frombuffer(r["cut"], "<f4").reshape(-1, features), np.frombuffer(r["total"], "<i8").reshape(-1, classes)
        if level == 0:
            forest.value[forest.roots[t]] = totals[t][0]
    open_ = {t: np.nonzero(~np.isnan(c).all(axis=1))[0] for t, c in cuts.items()}
    some = {t: o for t, o in open_.items() if len(o)}
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def tried(t: int) -> np.ndarray:
        """Features with a cut of every open node in ascending order, filled up with others where a node has fewer."""
        none = np.isnan(cuts[t][some[t]])
        return np.sort(np.argsort(none, axis=1, kind="stable")[:, : int((~none).sum(axis=1).max())], axis=1)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for share, units in _held(batches, folds):
                for t, spots in some.items():
                    if t % shares != share:
                        continue
                    right = np.zeros((count[t] * classes, features), np.int64)
                    seen = False
                    for unit in units:
                        order, key = sorted_rows(t, unit)
                        if len(order):
                            seen = True
                            here, size = segments(key)
                            right[here] += _above(unit.x, order, size, cuts[t], here // classes)
                    if seen:
                        right = np.take_along_axis(right.reshape(-1, classes, features)[spots], tried(t)[:, None, :], axis=2)
                        # In as few bytes as the largest count takes.
                        yield {"tree": t, "right": right.astype(np.min_scalar_type(int(right.max()))).tobytes()}

        yield from _answers(rows(), pa.schema([("tree", pa.int64()), ("right", pa.binary())]))

    def best(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        spots, columns = some[t], tried(t)
        right = np.zeros((len(spots), classes, columns.shape[1]), np.int64)
        for b in table.column("right").to_pylist():
            right += np.frombuffer(b, f"u{len(b) // right.size}").reshape(right.shape)
        left = totals[t][spots][:, :, None] - right
        n_left, n_right = left.sum(axis=1), right.sum(axis=1)
        fine = ~np.isnan(np.take_along_axis(cuts[t][spots], columns, axis=1)) & (n_left > 0) & (n_right > 0)
        purity = (left.astype(float) ** 2).sum(axis=1) / np.maximum(n_left, 1) + (right.astype(float) ** 2).sum(axis=1) / np.maximum(n_right, 1)
        place = np.argmax(np.where(fine, purity, -1.0), axis=1)
        every = np.arange(len(spots))
        feature = np.where(fine[every, place], columns[every, place], -1)
        chosen = right[every, :, place]
        return pa.table({"tree": [t], "feature": pa.array([feature.astype("<i4").tobytes()], pa.binary()), "right": pa.array([chosen.astype("<i8").tobytes()], pa.binary())})

    won = _added(blocks, sides, "tree long, right binary", "tree", best, "tree long, feature binary, right binary", tasks * 8 * classes * features * sum(len(o) for o in some.values()))
    spots, feature, cut, right, total, tree = [], [], [], [], [], []
    for w in won:
        t, f, r = w["tree"], np.frombuffer(w["feature"], "<i4"), np.frombuffer(w["right"], "<i8").reshape(-1, classes)
        good = f >= 0
        spots.append(first[t] + some[t][good])
        feature.append(f[good])
        cut.append(cuts[t][some[t][good], f[good]])
        right.append(r[good])
        total.append(totals[t][some[t][good]])
        tree.append(np.full(good.sum(), t))
    spots, feature, cut, right, total, tree = (np.concatenate(v) for v in (spots, feature, cut, right, total, tree))
    left = forest.grown(active[spots], feature, cut, total - right, right)
    key = keys[spots]
    node, tree, key = np.concatenate([left, left + 1]), np.concatenate([tree, tree]), np.concatenate([child_keys(key, 0), child_keys(key, 1)])
    # A node of one class is a leaf.
    mixed = (forest.value[node] > 0).sum(axis=1) > 1
    return node[mixed], tree[mixed], key[mixed]


def extra_trees(df: DataFrame, label: str, trees: int = 1200, subset: str | int | float = "all", depth: int = 10, bootstrap: bool = False, features: str = "features", seed: int = SEED) -> Forest:
    """Extremely randomised trees: every node draws one cut for each of its features, uniformly between the values it holds, and keeps the best.

    Labels are classes 0, 1, ...; rows with a null label or null features are not learnt from. ``bootstrap`` draws every row a
    Poisson(1) number of times per tree.
    """
    blocks = packed_rows(df, features, [label])
    classes, width = _shape(blocks)
    return Forest(grow_extra_trees(blocks, [Plan(i, subset_size(subset, width), depth) for i in range(trees)], classes, width, bootstrap, seed), depth, features)


def _shape(blocks: DataFrame) -> tuple[int, int]:
    """Classes and features of packed rows."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, w in zip(batch.column("c0").to_pylist(), batch.column("width").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(c, "<f8").max()) + 1], pa.int64()), pa.array([w], pa.int64())], ["classes", "width"])

    found = blocks.select("c0", "width").mapInArrow(top, "classes long, width long").agg(F.max("classes").alias("classes"), F.max("width").alias("width")).first()
    if found.classes is None:
        raise ValueError("there is no row with a label and features")
    return found.classes, found.width


def extra_trees_by_fold(df: DataFrame, label: str, fold: str, folds: int, configs: Sequence[dict], features: str = "features", seed: int = SEED) -> DataFrame:
    """Fits of every configuration (``trees``, ``subset``, ``depth``) without each fold, and their hits: ``(config_id, fold, test_rows, test_hits, train_rows, train_hits)``.

    The trees of all configurations and folds grow together, so there are as many scans for one as for all of them (a level with more numbers
    than a scan may hold takes more), and one more scan scores them.
    """
    blocks = packed_rows(df, features, [label, fold])
    classes, width = _shape(blocks)
    plans, group = [], []
    for c, config in enumerate(configs):
        for f in range(folds):
            plans += [Plan(i, subset_size(config["subset"], width), config["depth"], f) for i in range(config["trees"])]
            group += [(c, f)] * config["trees"]
    forest = grow_extra_trees(blocks, plans, classes, width, seed=seed)
    depth = [c["depth"] for c in configs]
    paths = forest.paths(np.arange(len(plans)))
    value = forest.value[paths.node].astype(np.int64 if forest.value.max(initial=0) >= 1 << 31 else np.int32)
    paths = replace(paths, node=None)
    # Where blocks are few, the fits are shared out.
    cells, _, shares = _dealt(blocks, len(configs) * folds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _lowest(np.frombuffer(batch.column("x")[i].as_py(), "<f4").reshape(-1, width))
                y, at = (np.frombuffer(batch.column(c)[i].as_py(), "<f8").astype(np.int64) for c in ("c0", "c1"))
                out = []
                for fit, ((c, f), trees) in enumerate(groupby(range(len(group)), key=group.__getitem__)):
                    if fit % shares != batch.column("share")[i].as_py():
                        continue
                    p = sum(_shares(value.take(paths.walked(x, t, depth[c]), axis=0)) for t in trees)
                    hit, test = np.argmax(p, axis=1) == y, at == f
                    out.append((c, f, int(test.sum()), int((hit & test).sum()), int((~test).sum()), int((hit & ~test).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["config_id", "fold", "test_rows", "test_hits", "train_rows", "train_hits"])

    sums = ["test_rows", "test_hits", "train_rows", "train_hits"]
    parts = cells.mapInArrow(score, "config_id long, fold long, " + ", ".join(f"{s} long" for s in sums))
    return parts.groupBy("config_id", "fold").agg(*[F.sum(s).alias(s) for s in sums])


# --- boosting -----------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosted:
    """Rounds of trees over binned features; ``value`` of a leaf is what it adds to the margin of its class."""

    trees: Trees
    per_round: int
    base: np.ndarray
    borders: np.ndarray
    depth: int
    features: str
    classes: int
    losses: list[float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self._walked(_binned(x, self.borders))

    def _walked(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for t in range(len(self.trees.roots)):
            out[:, t % self.per_round] += self.trees.value[self.trees.leaves(bins, t, self.depth), 0]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and for classes ``probability`` (array by class); null features give null.

        Rows of equal bins have equal margins: where there are few combinations of bins, a task walks down the trees once for each of them.
        """
        model = self
        width, size = len(self.borders), self.borders.shape[1] + 1
        steps = size ** np.arange(width) if size**width <= MOST_CELLS else None

        @F.pandas_udf("array<double>")
        def margin(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            spot, known = None if steps is None else np.full(size**width, -1, np.int32), []
            for s in parts:
                some = s.notna().to_numpy()
                out = pd.Series([None] * len(s), s.index, object)
                if some.any():
                    x = _binned(np.clip(np.stack(s[some].to_numpy()).astype(float), -_F32, _F32).astype(np.float32), model.borders)
                    if spot is None:
                        m = model._walked(x)
                    else:
                        cell = x @ steps
                        new, first = np.unique(cell, return_index=True)
                        new, first = (v[spot[new] < 0] for v in (new, first))
                        if len(new):
                            spot[new] = sum(map(len, known)) + np.arange(len(new))
                            known = [np.concatenate([*known, model._walked(x[first])])]
                        m = known[0][spot[cell]]
                    out[some] = pd.Series(list(_probabilities(m) if model.classes else m), s.index[some])
                yield out

        scored = df.withColumn("probability" if self.classes else "__margin", margin(_as_array(df, self.features)))
        if self.classes:
            return scored.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
        return scored.withColumn("prediction", F.col("__margin")[0]).drop("__margin")


def _probabilities(margins: np.ndarray) -> np.ndarray:
    """Softmax of the margins; a single one is that of class 1 against 0."""
    if margins.shape[1] == 1:
        margins = np.hstack([np.zeros_like(margins), margins])
    up = np.exp(margins - margins.max(axis=1, keepdims=True))
    return up / up.sum(axis=1, keepdims=True)


def _binned(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Bin of every value: how many borders lie below it; NaN is above all."""
    out = np.empty(x.shape, np.int16)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(borders[j], x[:, j].astype(float), "left")
    out[np.isnan(x)] = borders.shape[1]
    return out


def gradients(margins: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by every margin: squared error, logistic, or softmax over all classes at once."""
    if not classes:
        return margins - y[:, None], np.ones_like(margins)
    p = _probabilities(margins)
    if margins.shape[1] == 1:
        p = p[:, 1:]
        return p - y[:, None], p * (1 - p)
    return p - (y[:, None] == np.arange(classes)[None, :]), p * (1 - p)


def drawn_columns(features: int, shares: Sequence[float], keys: Sequence[int], seed: int) -> np.ndarray:
    """Features left after drawing a share of them for each key in turn, at least one."""
    left = np.arange(features)
    for share, key in zip(shares, keys, strict=True):
        if share < 1:
            order = np.argsort(draws(np.array([_mixed(np.uint64(key) + _mixed(np.uint64(seed)))], np.uint64), features, 3)[0][left], kind="stable")
            left = np.sort(left[order[: max(1, int(share * len(left)))]])
    out = np.zeros(features, bool)
    out[left] = True
    return out


def boost(
    df: DataFrame, label: str, classes: int, rounds: int, rate: float, depth: int, penalty: float = 1.0, least_weight: float = 1.0, by_tree: float = 1.0, by_level: float = 1.0,
    by_node: float = 1.0, bins: int = 64, features: str = "features", seed: int = SEED, write_rounds: int | None = None,
) -> Boosted:
    """Second-order gradient boosting with histograms; ``classes`` is 0 for a number, else how many classes 0, 1, ... the label has.

    Features are cut once into ``bins`` ranges of about equally many rows. A round fits one tree for every class (one for two classes or a
    number) to the derivatives of the joint loss. A level is one scan: tasks sum both derivatives by class, node, feature and bin as whole
    numbers, and each node takes the cut of most gain ``GL^2/(HL+penalty) + GR^2/(HR+penalty) - G^2/(H+penalty)`` whose sides weigh ``least_weight`` or
    more, of equal ones the first. Leaves hold ``-rate * G / (H + penalty)``. Columns are drawn per tree, then per level, then per node. Margins are
    written every ``write_rounds`` rounds; the trees since are walked again. Rows with a null are not learnt from; NaN is above all values.
    Where the columns drawn for a tree have few combinations of bins, tasks sum by these, once for all levels of the tree.

    No tree tells rows of the same bins apart. If few features have at most ``MOST_CELLS`` combinations of bins, the rows of each are added up once
    (for classes, those of each class), and the scans of all rounds read these sums, which don't grow with the rows.
    """
    columns = 1 if classes in (0, 2) else classes
    raw = packed_rows(df, features, [label])
    borders = _borders(df, features, label, bins)
    width = len(borders)
    base, unit = _start(raw, classes, columns)

    few = (bins + 1) ** width <= MOST_CELLS
    write_rounds = write_rounds or (CELL_WRITE_ROUNDS if few else WRITE_ROUNDS)
    rows = cut_lineage(_summed_cells(raw, borders, base, unit, classes) if few else _binned_rows(raw, borders, base, unit, classes))
    tasks = rows.rdd.getNumPartitions()
    kept = _kept(rows) if few else None
    done: list[Trees] = []
    losses: list[float] = []
    written = 0
    for n in range(rounds):
        if n - written == write_rounds:
            rows, written = cut_lineage(rows.mapInArrow(_walked(done[written:], columns, depth, width), _BLOCK)), n
            tasks = rows.rdd.getNumPartitions()
            if kept is not None:
                kept.unpersist()
                kept = _kept(rows)
        level = _Round(_no_trees(columns, 1, np.int16), n * columns, columns, classes, width, bins, depth, base, unit, rate, penalty, least_weight, (by_tree, by_level, by_node), seed)
        losses.append(level.grow(rows, kept, done[written:], tasks))
        done.append(level.trees)
    if kept is not None:
        kept.unpersist()
    return Boosted(_joined(done, columns), columns, base, borders, depth, features, classes, losses)


def _kept(rows: DataFrame) -> RDD:
    """Sums of cells, few as they are, in the memory of a few tasks, since every round reads them."""
    cells = rows.agg(F.coalesce(F.sum(F.octet_length("n")), F.lit(0))).first()[0] // 8
    held = rows.rdd.coalesce(max(1, min(rows.rdd.getNumPartitions(), -(-cells // TASK_CELLS))))
    names = rows.columns

    def batch(part: Iterator) -> Iterator[pa.RecordBatch]:
        values = list(part)
        if values:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in values], pa.binary()) for c in names], names)

    return held.mapPartitions(batch).persist()


def _joined(parts: Sequence[Trees], columns: int) -> Trees:
    """Trees of all rounds as one, in order."""
    if not parts:
        return _no_trees(0, 1, np.int16)
    at = np.cumsum([0, *(len(t.left) for t in parts)])
    left = [np.where(t.left >= 0, t.left + a, -1) for t, a in zip(parts, at[:-1], strict=True)]
    joined = lambda name: np.concatenate([getattr(t, name) for t in parts])
    return Trees(np.concatenate([a + np.arange(columns) for a in at[:-1]]), joined("feature"), joined("cut"), np.concatenate(left), joined("value"))


# Rows of a block: bins; label, or for a number the sum of its gaps to the first margin in whole units; how many rows; sum of the squared gaps; margins.
_BLOCK = "x binary, y binary, n binary, q binary, margins binary"


def _as_block(x: np.ndarray, y: np.ndarray, n: np.ndarray, q: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
    held = (x.astype("<i2"), y.astype("<i8"), n.astype("<i8"), q.astype("<f8"), np.tile(base, (len(x), 1)).astype("<f8"))
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in held], ["x", "y", "n", "q", "margins"])


def _binned_block(batch: pa.RecordBatch, i: int, borders: np.ndarray, base: np.ndarray, unit: float, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels (numbers: gaps to the first margin in whole units) and squared gaps of a block of packed rows."""
    x = _binned(np.frombuffer(batch.column("x")[i].as_py(), "<f4").reshape(-1, len(borders)), borders)
    y = np.frombuffer(batch.column("c0")[i].as_py(), "<f8")
    return (x, y.astype(np.int64), np.zeros(len(y))) if classes else (x, np.rint((y - base[0]) * unit).astype(np.int64), (y - base[0]) ** 2)


def _binned_rows(raw: DataFrame, borders: np.ndarray, base: np.ndarray, unit: float, classes: int) -> DataFrame:
    """A row of a block for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, q = _binned_block(batch, i, borders, base, unit, classes)
                yield _as_block(x, y, np.ones(len(x)), q, base)

    return raw.mapInArrow(run, _BLOCK)


def _summed_cells(raw: DataFrame, borders: np.ndarray, base: np.ndarray, unit: float, classes: int) -> DataFrame:
    """A row of a block for all rows of the same bins and, if there are classes, of the same class."""
    width, size = len(borders), borders.shape[1] + 1
    steps = size ** np.arange(width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, q = _binned_block(batch, i, borders, base, unit, classes)
                cell = x @ steps * max(1, classes) + (y if classes else 0)
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                edge = np.concatenate([[0], np.nonzero(cell[1:] != cell[:-1])[0] + 1])
                n = np.diff(np.concatenate([edge, [len(cell)]]))
                whole = np.zeros(len(edge), np.int64) if classes else np.add.reduceat(y[order], edge)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cell[edge], n, whole, np.add.reduceat(q[order], edge))], ["cell", "n", "y", "q"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, n, y, q = (batch.column(c).to_numpy() for c in ("cell", "n", "y", "q"))
                x = cell[:, None] // max(1, classes) // steps % size
                yield _as_block(x, cell % classes if classes else y, n, q, base)

    cells = raw.mapInArrow(sums, "cell long, n long, y long, q double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "y", "q")])
    return cells.repartition(raw.sparkSession.sparkContext.defaultParallelism).mapInArrow(pack, _BLOCK)


def _block(batch: pa.RecordBatch, i: int, columns: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, y, n, q, margins = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("x", "<i2"), ("y", "<i8"), ("n", "<i8"), ("q", "<f8"), ("margins", "<f8")))
    return x.reshape(-1, width), y, n, q, margins.reshape(-1, columns).copy()


def _add_rounds(margins: np.ndarray, x: np.ndarray, rounds: Sequence[Trees], depth: int) -> None:
    for trees in rounds:
        for k in range(margins.shape[1]):
            margins[:, k] += trees.value[trees.leaves(x, k, depth), 0]


def _walked(rounds: Sequence[Trees], columns: int, depth: int, width: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, n, q, margins = _block(batch, i, columns, width)
                _add_rounds(margins, x, rounds, depth)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, n, q, margins)], ["x", "y", "n", "q", "margins"])

    return walk


def _whole_sums(cell: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by cell, exact: doubles hold them up to 2 ** 53, so large ones are added in two parts."""
    if np.abs(values).max(initial=0) * float(len(cell)) < 2**53:
        return np.bincount(cell, values.astype(float), size).astype(np.int64)
    high, low = values >> 26, values & ((1 << 26) - 1)
    return (np.bincount(cell, high.astype(float), size).astype(np.int64) << 26) + np.bincount(cell, low.astype(float), size).astype(np.int64)


@dataclass
class _Round:
    """Trees of one round, one for every margin, and what they are grown by; ``first`` is the number of the first of all rounds' trees."""

    trees: Trees
    first: int
    columns: int
    classes: int
    width: int
    bins: int
    depth: int
    base: np.ndarray
    unit: float
    rate: float
    penalty: float
    least_weight: float
    shares: tuple[float, float, float]
    seed: int

    def grow(self, rows: DataFrame, kept: RDD | None, since: Sequence[Trees], tasks: int) -> float:
        """Grow the trees on ``rows``, whose margins lack the rounds ``since``; returns the loss before the round. ``kept`` are the same rows in memory."""
        active, owner = self.trees.roots.copy(), np.arange(self.columns)
        drawn = [np.nonzero(drawn_columns(self.width, self.shares[:1], (self._tree_key(k),), self.seed))[0] for k in range(self.columns)]
        boxes = None
        if tasks * 16 * sum((self.bins + 1) ** len(d) for d in drawn) <= ANSWER_BYTES:
            boxes = [_Box(d, np.zeros(len(d), np.int64), np.full(len(d), self.bins + 1)) for d in drawn]
        loss, sums = math.nan, []
        for level in range(self.depth):
            won = _boost_level(rows, kept, self, since, level, active, owner, tasks, boxes, sums)
            if level == 0:
                loss = sum(r["loss"] for r in won) / max(1, sum(r["seen"] for r in won))
                # A tree that doesn't split is its root.
                for r in won:
                    self.trees.value[active[r["node"]], 0] = r["own"]
            split = [r for r in won if r["feature"] >= 0]
            if not split:
                break
            spots = np.array([r["node"] for r in split])
            left = self.trees.grown(active[spots], np.array([r["feature"] for r in split], np.int32), np.array([r["bin"] for r in split], np.int16),
                                    np.array([[r["left"]] for r in split]), np.array([[r["right"]] for r in split]))
            if boxes is not None:
                halves = [boxes[r["node"]].cut(r["feature"], r["bin"]) for r in split]
                boxes = [half[side] for side in (0, 1) for half in halves]
            active, owner = np.concatenate([left, left + 1]), np.concatenate([owner[spots], owner[spots]])
        return loss

    def _tree_key(self, k: int) -> int:
        return (self.first + k) << 20

    def best_cut(self, g: np.ndarray, h: np.ndarray, level: int, owner: int, node: int) -> dict:
        """Cut and values of a node of the tree ``owner`` from its sums by feature and bin, whole numbers; those of a feature that can't be drawn may be 0."""
        tree_key, level_key = self._tree_key(owner), self._tree_key(owner) + level + 1
        free = drawn_columns(self.width, self.shares, (tree_key, level_key, level_key * 1024 + 64 + node), self.seed)
        # A feature that may be cut has all sums. They are added as whole numbers.
        own = int(np.argmax(free))
        all_g, all_h = g[own].sum() / self.unit, h[own].sum() / float(1 << 30)
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1] / self.unit, np.cumsum(h, axis=1)[:, :-1] / float(1 << 30)
        right_g, right_h = all_g - left_g, all_h - left_h
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - all_g**2 / (all_h + self.penalty)
        gain[~free] = -1.0
        # Sums are rounded to 2 ** -30; sides below that are empty.
        least = max(self.least_weight, 1e-9)
        gain[(left_h < least) | (right_h < least) | ~np.isfinite(gain)] = -1.0
        f, b = divmod(int(np.argmax(np.round(gain, 9))), self.bins)
        good = gain[f, b] > 1e-9
        leaf = [-self.rate * float(x) / (float(w) + self.penalty) for x, w in ((left_g[f, b], left_h[f, b]), (right_g[f, b], right_h[f, b]), (all_g, all_h))]
        return {"feature": f if good else -1, "bin": b, "left": leaf[0], "right": leaf[1], "own": leaf[2]}


@dataclass
class _Box:
    """Ranges of bins, one for every column drawn for a tree, that lead to a node."""

    drawn: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def sums(self, g: np.ndarray, h: np.ndarray, width: int) -> list[np.ndarray]:
        """Sums by feature and bin from those by all combinations of bins of the drawn columns."""
        out = []
        for v in (g, h):
            part = v[tuple(slice(a, b) for a, b in zip(self.low, self.high, strict=True))]
            held = np.zeros((width, v.shape[0]), np.int64)
            for j, f in enumerate(self.drawn):
                held[f, self.low[j] : self.high[j]] = part.sum(axis=tuple(i for i in range(len(self.drawn)) if i != j))
            out.append(held)
        return out

    def cut(self, feature: int, border: int) -> tuple[_Box, _Box]:
        high, low = self.high.copy(), self.low.copy()
        high[self.drawn == feature] = low[self.drawn == feature] = border + 1
        return _Box(self.drawn, self.low, high), _Box(self.drawn, low, self.high)


def _derivatives(round_: _Round, batches: Iterator[pa.RecordBatch], since: Sequence[Trees]):
    """Bins of every block, both derivatives as whole numbers, the loss before the round and the number of rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, times, q, margins = _block(batch, i, round_.columns, round_.width)
            _add_rounds(margins, x, since, round_.depth)
            if round_.classes:
                g, h = (np.rint(v * float(1 << 30)).astype(np.int64) * times[:, None] for v in gradients(margins, y, round_.classes))
            else:
                # Whole numbers before they are added, so that sums are the same however rows are put together.
                g, h = np.rint((margins - round_.base) * round_.unit).astype(np.int64) * times[:, None] - y[:, None], times[:, None] << 30
            yield x, g, h, lambda: _loss(margins, y, times, q, round_.classes, round_.base, round_.unit), int(times.sum())  # noqa: B023


def _sum_boxes(round_: _Round, rows: DataFrame, kept: RDD | None, since: Sequence[Trees], drawn: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """Sums of derivatives of every tree by the combinations of bins of its columns, and the loss before the round: one scan for all levels."""
    size = round_.bins + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, size ** len(d)), np.int64) for d in drawn]
        loss, seen = 0.0, 0
        for x, g, h, lost, n in _derivatives(round_, batches, since):
            loss, seen = loss + lost(), seen + n
            for k, d in enumerate(drawn):
                cell = x[:, d].astype(np.int64) @ (size ** np.arange(len(d))[::-1])
                for j, v in enumerate((g, h)):
                    total[k][j] += _whole_sums(cell, v[:, k], total[k].shape[1])
        first = np.arange(len(drawn)) == 0
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(drawn))), *(pa.array([t[j].tobytes() for t in total], pa.binary()) for j in (0, 1)), pa.array(np.where(first, loss, 0.0)), pa.array(np.where(first, seen, 0))],
            ["tree", "g", "h", "loss", "seen"])

    if kept is None:
        held = rows.mapInArrow(sums, "tree long, g binary, h binary, loss double, seen long").toArrow()
    else:
        held = pa.Table.from_batches(kept.mapPartitions(sums).collect())
    out = []
    for k, d in enumerate(drawn):
        own = held.filter(pc.equal(held.column("tree"), k))
        g, h = (sum(np.frombuffer(b, np.int64) for b in own.column(c).to_pylist()).reshape((size,) * len(d)) for c in ("g", "h"))
        out.append((g, h, math.fsum(own.column("loss").to_pylist()), sum(own.column("seen").to_pylist())))
    return out


def _boost_level(rows: DataFrame, kept: RDD | None, round_: _Round, since: Sequence[Trees], level: int, active: np.ndarray, owner: np.ndarray, tasks: int, boxes: list[_Box] | None, held: list) -> list[dict]:
    """Cuts of the nodes of one level by a scan of their sums by feature and bin, and at the root the loss before the round.

    With ``boxes`` there is a scan at the root only: its sums stay in ``held``, and the nodes below read theirs from them.
    """
    trees, width, bin_count = round_.trees, round_.width, round_.bins + 1
    if boxes is not None:
        if level == 0:
            held += _sum_boxes(round_, rows, kept, since, [b.drawn for b in boxes])
        won = []
        for a, k in enumerate(owner.tolist()):
            g, h, loss, seen = held[k]
            won.append({"node": a, **round_.best_cut(*boxes[a].sums(g, h, width), level, k, int(active[a])), "loss": loss, "seen": seen})
        return won
    slot = np.full(len(trees.left), -1, np.int64)
    slot[active] = np.arange(len(active))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(active) * width * bin_count), np.int64)
        loss, seen = 0.0, 0
        for x, g, h, lost, n in _derivatives(round_, batches, since):
            if level == 0:
                loss, seen = loss + lost(), seen + n
            for k in range(round_.columns):
                node = slot[trees.leaves(x, k, level)]
                good = np.nonzero(node >= 0)[0]
                if not len(good):
                    continue
                cell = ((node[good, None] * width + np.arange(width)) * bin_count + x[good]).ravel()
                for j, v in enumerate((g, h)):
                    total[j] += _whole_sums(cell, np.repeat(v[good, k], width), total.shape[1])
        size = width * bin_count
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(active))), *(pa.array([total[j, a * size : (a + 1) * size].tobytes() for a in range(len(active))], pa.binary()) for j in (0, 1)),
            pa.array(np.where(np.arange(len(active)) == 0, loss, 0.0)), pa.array(np.where(np.arange(len(active)) == 0, seen, 0))], ["node", "g", "h", "loss", "seen"])

    def choose(table: pa.Table) -> pa.Table:
        a = table.column("node")[0].as_py()
        g, h = (sum(np.frombuffer(b, np.int64).reshape(width, bin_count) for b in table.column(c).to_pylist()) for c in ("g", "h"))
        best = round_.best_cut(g, h, level, int(owner[a]), int(active[a]))
        return pa.table({"node": [a], **{k: [v] for k, v in best.items()}, "loss": [math.fsum(table.column("loss").to_pylist())], "seen": [sum(table.column("seen").to_pylist())]})

    return _added(
        rows, sums, "node long, g binary, h binary, loss double, seen long", "node", choose,
        "node long, feature long, bin long, left double, right double, own double, loss double, seen long", tasks * 16 * len(active) * width * bin_count)


def _loss(margins: np.ndarray, y: np.ndarray, times: np.ndarray, q: np.ndarray, classes: int, base: np.ndarray, unit: float) -> float:
    """Sum of squared errors, or of negative log probabilities."""
    if not classes:
        gap = margins[:, 0] - base[0]
        return max(0.0, float((times * gap * gap - 2 * gap * (y / unit) + q).sum()))
    return float(-(times * np.log(np.maximum(_probabilities(margins)[np.arange(len(y)), y], 1e-300))).sum())


def _borders(df: DataFrame, features: str, label: str, bins: int) -> np.ndarray:
    """``bins - 1`` quantiles of every feature, and infinity; values up to a border and above the last one share a bin."""
    rows = df.filter(F.col(label).isNotNull()).select(_as_array(df, features).alias("x")).dropna()
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        raise ValueError("there is no row with a label and features")
    at = [(i + 1) / bins for i in range(bins - 1)]
    values = [F.percentile_approx(F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]), at, 10_000).alias(f"q{j}") for j in range(width)]
    found = rows.agg(*values).first()
    held = np.array([q if q is not None else [0.0] * (bins - 1) for q in found], float)
    # As the rows are: single precision.
    held = np.clip(held, -_F32, _F32).astype(np.float32).astype(float)
    return np.hstack([held, np.full((width, 1), np.inf)])


def _start(raw: DataFrame, classes: int, columns: int) -> tuple[np.ndarray, float]:
    """First margins, and the whole number that a derivative of 1 becomes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column("c0").to_pylist():
                y = np.frombuffer(c, "<f8")
                counts = np.bincount(y.astype(int), minlength=classes).tolist() if classes else []
                if classes and len(counts) > classes:
                    raise ValueError(f"labels are classes below {classes}")
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (len(y), y.sum(), y.min(), y.max(), [float(v) for v in counts])], ["n", "total", "least", "most", "counts"])

    parts = raw.select("c0").mapInArrow(sums, "n long, total double, least double, most double, counts array<double>")
    n, total, least, most = parts.agg(F.sum("n"), F.sum("total"), F.min("least"), F.max("most")).first()
    if not classes:
        # Residuals rarely leave twice the range of the label; whole numbers have room for far more.
        # Rounded, so that the order of the sum does not show.
        return np.array([float(np.float32(total / n))]), float(1 << 30) / max(most - least, 1e-12)
    counts = np.array([parts.agg(F.sum(F.col("counts")[k])).first()[0] for k in range(classes)])
    share = (counts + 1e-9) / (counts.sum() + 1e-9 * classes)
    if columns == 1:
        return np.array([math.log(share[1] / share[0])]), float(1 << 30)
    return np.log(share), float(1 << 30)

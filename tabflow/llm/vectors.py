"""Embedding near-dedup: an exact range join of vectors by the angle between them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.components import connected
from tabflow.llm.streams import block_streams, vectors
from tabflow.session import cut_lineage

# Vectors that pivots are chosen from, and most pivots.
SAMPLE, MOST_PIVOTS = 2048, 1024
# Vectors a pivot stands for, on average, and most members and visitors of a block.
CELL_ROWS, PIECE_ROWS, VISIT_ROWS = 8192, 8192, 131_072
# More than rounding can move an angle, and a product of single-precision unit vectors.
SLACK, SINGLE = 1e-6, 1e-5


def list_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of a matrix, shorter ones filled up with zeros, and which of them are non-empty, without null and all finite."""
    column = column.cast(pa.list_(pa.float64()))
    n = len(column)
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), sizes)
    x = np.zeros((n, int(sizes.max()) if n else 0))
    x[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    good = (sizes > 0) & np.isfinite(x).all(axis=1)
    return x, good


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they were scaled to a largest component near 1 before."""
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def _choose_pivots(u: np.ndarray, most: int, reach: float) -> np.ndarray:
    """Means of the sampled vectors around those with most others within ``reach``, none of them within reach of another."""
    near = u @ u.T >= math.cos(reach)
    free, picked = np.ones(len(u), bool), []
    for i in np.argsort(-near.sum(axis=1), kind="stable"):
        if len(picked) == most:
            break
        if free[i]:
            mean = u[near[i]].sum(axis=0)
            size = np.linalg.norm(mean)
            picked.append(mean / size if size > 0.1 else u[i])
            free[near[i]] = False
    return np.array(picked)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest number that pairs ``(a, b)`` lead each of n nodes to, from ``root`` on."""
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def linked_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, sample: int = SAMPLE, cell_rows: int = CELL_ROWS,
    piece_rows: int = PIECE_ROWS, visit_rows: int = VISIT_ROWS,
) -> DataFrame:
    """All pairs of vectors with a cosine of ``least`` or more: one row per vector with key, n_links, component_id and kept.

    n_links counts the other vectors linked directly, component_id is the smallest key that links lead to (itself included), kept says that it is
    the row's own. Cosines are taken in double precision; ``least`` is above 0.

    Equal vectors are one node that knows how many it stands for. Pivots are chosen from a bounded sample (``sample`` nodes); every node belongs to
    the cell of its nearest pivot. A cell has a core, the nodes within half the reach (the angle of ``least``) of the pivot, and a rest. By the triangle
    inequality two nodes of a core are always linked, and a node has no link into a core or rest whose radius plus the reach is less than
    its angle to the pivot, nor across a border between two pivots that is further away than the reach. It visits the others of smaller number, and
    these are compared independently: single-precision products decide pairs that are clearly linked or not, the double cosine those near the border.
    Cells are cut into pieces of ``piece_rows`` members and ``visit_rows`` visitors; blocks report counts and a spanning forest of their links,
    never pairs. Where many different vectors lie neither within half the reach of a pivot nor further apart than the reach, or dimensions
    are many and vectors lie without order, bounds rule out little and blocks compare most pairs.

    A vector that is null, empty, zero or holds a null or a non-finite component links with nothing. Vectors of different lengths are compared as if the
    shorter one ended in zeros. Rows of equal keys are vectors of their own. A null key is never the smallest; a component without any
    other has a null component_id and keeps its rows. Labels and other columns are ignored.
    """
    reach = math.acos(least)
    kind = rows.schema[key].dataType
    spark = rows.sparkSession
    cast = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = list_matrix(batch.column("vector"))
            x = np.where(good[:, None], x, 0.0)
            # Halving and doubling changes no angle and keeps squares in range.
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) + 0.0
            good &= (x != 0).any(axis=1)
            size = np.where(good, x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1) if x.shape[1] else 0, 0)
            held = [x[i, : size[i]].tobytes() if g else None for i, g in enumerate(good.tolist())]
            mark = [None if h is None else hashlib.sha256(h).digest() for h in held]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(held, pa.binary()), pa.array(mark, pa.binary())], ["key", "held", "mark"])

    marked = cut_lineage(cast.mapInArrow(normal, "key long, held binary, mark binary"))
    groups = marked.filter("mark is not null").groupBy("mark").agg(F.first("held").alias("held"), F.count("*").alias("copies"), F.min("key").alias("least"))
    nodes = cut_lineage(groups.withColumn("node", F.monotonically_increasing_id()))
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("held")), F.lit(0)).alias("b")).first()
    n, dims = size.n, size.b // 8
    out = marked.select("key", "mark")
    if n:
        counts, links = _compare(nodes, n, dims, reach, least, sample, cell_rows, piece_rows, visit_rows)
        roots = connected(links)
        named = nodes.join(counts, "node", "left").join(roots, "node", "left").select("mark", "copies", "least", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
        named = cut_lineage(named)
        smallest = named.groupBy("root").agg(F.min("least").alias("component"))
        found = named.join(smallest, "root").select("mark", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component")
    else:
        found = spark.createDataFrame([], "mark binary, n_links long, component long")
    out = out.join(found, "mark", "left")
    component = F.when(F.col("mark").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(
        F.col("key").cast(kind).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def _compare(nodes: DataFrame, n: int, dims: int, reach: float, least: float, sample: int, cell_rows: int, piece_rows: int, visit_rows: int) -> tuple[DataFrame, DataFrame]:
    """Linked vectors of every node that has any, as ``(node, n)``, and links ``(a, b)`` that connect what is connected."""
    spark = nodes.sparkSession

    def matrix(column) -> np.ndarray:
        parts = column.to_pylist()
        if parts and all(len(p) == 8 * dims for p in parts):
            return vectors(column)
        x = np.zeros((len(parts), dims))
        for i, p in enumerate(parts):
            x[i, : len(p) // 8] = np.frombuffer(p, "<f8")
        return x

    drawn = nodes.select("held", F.xxhash64("mark").alias("order")).orderBy("order").limit(min(sample, n)).select("held").toArrow()
    pivots = _choose_pivots(_units(matrix(drawn.column("held").combine_chunks())), max(1, min(MOST_PIVOTS, -(-n // cell_rows))), reach)
    k = len(pivots)
    between = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2) if k * k * dims < 5e7 else np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(_units(matrix(batch.column("held"))), pivots)
            home = np.argmin(angle, axis=1)
            near = angle[np.arange(len(home)), home]
            cell = home + np.where(near <= reach / 2 - SLACK, 0, k)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("held"), batch.column("copies"), pa.array(cell, pa.int64()), pa.array(near)], ["node", "held", "copies", "cell", "near"])

    home = cut_lineage(nodes.select("node", "held", "copies").mapInArrow(settled, "node long, held binary, copies long, cell long, near double"))
    # Two rows for each pivot at most.
    known = {r.cell: r for r in home.groupBy("cell").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("near").alias("far"), F.min("node").alias("lead")).collect()}
    far = np.array([known[c].far if c in known else -10.0 for c in range(2 * k)])
    count = np.array([known[c].n if c in known else 0 for c in range(2 * k)], np.int64)
    pieces = -(-count // piece_rows)

    def placed(u: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which cells each node visits; those of smaller number, and the own one if it is a rest of several pieces."""
        product = u @ pivots.T
        angle = np.arccos(np.clip(product, -1.0, 1.0))
        own = cell % k
        close = np.concatenate([angle, angle], axis=1) <= far[None, :] + reach + SLACK
        gap = product[np.arange(len(u)), own][:, None] - product
        across = gap <= math.sin(reach) * between[own] + SLACK
        visit = close & np.concatenate([across, across], axis=1) & (np.arange(2 * k)[None, :] < cell[:, None])
        visit[np.arange(len(u)), cell] = (cell >= k) & (pieces[cell] > 1)
        return visit

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A member row for each node and a row for each piece it visits."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cell, node = part.column("cell").to_numpy(), part.column("node").to_numpy()
                own = _piece_of(node, pieces[cell])
                who, where = np.nonzero(placed(_units(matrix(part.column("held"))), cell))
                times = pieces[where]
                who, where = np.repeat(who, times), np.repeat(where, times)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                # Two pieces of one rest meet once, in the smaller one.
                keep = (where != cell[who]) | (piece < own[who])
                who, where, piece = who[keep], where[keep], piece[keep]
                index = np.concatenate([np.arange(len(cell)), who])
                role = np.concatenate([np.zeros(len(cell), np.int32), np.ones(len(who), np.int32)])
                cell, piece = np.concatenate([cell, where]), np.concatenate([own, piece])
                for i in range(0, len(index), 8192):
                    some = slice(i, i + 8192)
                    out = [part.column(c).take(pa.array(index[some])) for c in ("node", "held", "copies")]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(cell[some]), pa.array(piece[some]), pa.array(role[some])], ["node", "held", "copies", "cell", "piece", "role"])

    shape = "node long, held binary, copies long, cell long, piece long, role int"
    visits = home.mapInArrow(sent, shape)
    # Visitors of a piece are dealt into chunks, each of which meets all its members.
    met = visits.filter("role = 1").groupBy("cell", "piece").agg(F.count("*").alias("v")).filter(F.col("v") > visit_rows).collect() if n > visit_rows else []
    if met:
        chunks = spark.createDataFrame([(r.cell, r.piece, -(-r.v // visit_rows)) for r in met], "cell long, piece long, chunks long")
        cut = visits.join(F.broadcast(chunks), ["cell", "piece"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        some = F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("chunks"))))
        visits = cut.withColumn("chunk", F.explode(some)).drop("chunks")
    else:
        visits = visits.withColumn("chunk", F.lit(0).cast("long"))

    def meet(members: pa.Table, visitors: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        cell, chunk = members.column("cell")[0].as_py(), members.column("chunk")[0].as_py()
        node, copies = members.column("node").to_numpy(), members.column("copies").to_numpy()
        x = matrix(members.column("held"))
        u = _units(x)
        single = u.astype(np.float32)
        m = len(node)
        total = np.zeros(m, np.int64)
        root = np.arange(m)

        def pairs(y: np.ndarray, single_y: np.ndarray, after: int | None) -> tuple[np.ndarray, np.ndarray]:
            product = single_y @ single.T
            a, b = np.nonzero(product >= np.float32(least - SINGLE))
            if after is not None:
                a, b = a[b > a + after], b[b > a + after]
            unsure = product[a, b] <= np.float32(least + SINGLE)
            if unsure.any():
                i, j = a[unsure], b[unsure]
                p, q = y[i], x[j]
                cosine = np.einsum("ij,ij->i", p, q) / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
                keep = np.ones(len(a), bool)
                keep[np.nonzero(unsure)[0][cosine < least]] = False
                a, b = a[keep], b[keep]
            return a, b

        if chunk == 0:
            if cell < k:
                # A core is linked throughout; each piece counts what all of them stand for.
                total += known[cell].copies - copies
                root[:] = 0
                yield _report([], [], [known[cell].lead], [node[0]])
            else:
                for at in range(0, m, 1024):
                    a, b = pairs(x[at : at + 1024], single[at : at + 1024], at)
                    a = a + at
                    np.add.at(total, a, copies[b])
                    np.add.at(total, b, copies[a])
                    root = _local_roots(m, a, b, root)
        for other in visitors:
            y = matrix(other.column("held"))
            who, weight = other.column("node").to_numpy(), other.column("copies").to_numpy()
            a, b = pairs(y, _units(y).astype(np.float32), None)
            if not len(a):
                continue
            np.add.at(total, b, weight[a])
            mine = np.bincount(a, weights=copies[b].astype(float), minlength=len(who)).astype(np.int64)
            # Members that a visitor links hang together; one link takes the visitor there.
            first = np.unique(a, return_index=True)
            lead = np.zeros(len(who), np.int64)
            lead[first[0]] = b[first[1]]
            root = _local_roots(m, lead[a], b, root)
            some = np.nonzero(mine)[0]
            yield _report(who[some], mine[some], who[some], node[lead[some]])
        some = np.nonzero(total)[0]
        hung = np.nonzero(root != np.arange(m))[0]
        yield _report(node[some], total[some], node[hung], node[root[hung]])

    result = cut_lineage(block_streams(visits, ["cell", "piece", "chunk"], meet, "node long, n long, a long, b long"))
    counts = result.filter("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    return counts, result.filter("a is not null and a <> b").select("a", "b")


def _piece_of(node: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    from tabflow.llm.words import spread64

    return (spread64(node.astype(np.uint64)) % np.maximum(pieces, 1).astype(np.uint64)).astype(np.int64)


def _report(node, n, a, b) -> pa.RecordBatch:
    """Counts and links below each other."""
    rows, links = len(node), len(a)
    none_n, none_l = pa.nulls(rows, pa.int64()), pa.nulls(links, pa.int64())
    columns = [(pa.array(node, pa.int64()), none_l), (pa.array(n, pa.int64()), none_l), (none_n, pa.array(a, pa.int64())), (none_n, pa.array(b, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["node", "n", "a", "b"])

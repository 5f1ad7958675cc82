"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled tokens they share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import words as W
from tabflow.llm.components import connected
from tabflow.llm.shingles import shingle_sets
from tabflow.session import cut_lineage

# Tokens that stand for a set while it is split: the smallest hashes of the set.
SKETCH = 64
# Children a set is expected to go to at every step; over 1/threshold, so that similar pairs seldom die out.
BRANCHES = 2.0
# Steps before buckets are first looked at, and at most.
FIRST_DEPTH, MOST_DEPTH = 2, 4
# Sets in a bucket that is compared by brute force.
BUCKET = 256
# Sets of a larger bucket that others may stand behind, and the similarity of sketches from which they do.
LEADERS, BEHIND = 8, 0.75
# How far below the threshold an estimated similarity may be for sets to be compared exactly.
MARGIN = 0.3
# Sets and bytes of text that one task verifies at once.
BLOCK_SETS, BLOCK_BYTES = 400, 4 << 20
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def runs_for(recall: float, threshold: float) -> int:
    """Independent runs after which a pair at the threshold has met in a bucket with probability ``recall``, however deep its buckets were split."""
    met = 1.0
    for _ in range(MOST_DEPTH):
        met = 1 - math.exp(-BRANCHES * threshold * met)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """key, mark, sid (hash of the whole set; null without words), size, n_bytes, sketch."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole, "text"):
                texts = W.filled(batch.column("text"))
                sets = shingle_sets(texts, width)
                sid = [_sid(s) for s in sets]
                sketch = [(W.spread64(s)[:0] if not len(s) else np.sort(W.spread64(s))[:SKETCH]) >> np.uint64(32) for s in sets]
                data, at = W.raw_bytes(texts)
                out = [pa.array(sid, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.diff(at), pa.int64()),
                       pa.array([s.astype("<u4").tobytes() for s in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), *out], names=["key", "mark", "sid", "size", "n_bytes", "sketch"])

    return docs.mapInArrow(run, f"key {kind}, mark long, sid long, size int, n_bytes long, sketch binary")


def _sid(tokens: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def _chosen(nodes: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with a node and ``counts`` tokens each: rows and nodes of the children their tokens lead to."""
    row = np.repeat(np.arange(len(nodes)), counts)
    draw = W.spread64(nodes[row] + tokens * np.uint64(0xD6E8FEB86659FD93))
    least = np.minimum(BRANCHES / np.maximum(counts, 1), 1.0)
    goes = draw <= (least * float(FULL >> np.uint64(11))).astype(np.uint64)[row] << np.uint64(11)
    goes |= (least >= 1)[row]
    return row[goes], W.spread64(draw[goes] ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0)).astype(np.uint64), np.array([len(p) for p in parts], np.int64)


def _first_paths(sketches: DataFrame, runs: int) -> DataFrame:
    """node and sid of every bucket after ``FIRST_DEPTH`` steps, in all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = _tokens(batch.column("sketch"))
            ends = np.cumsum(counts)
            sid = batch.column("sid").to_numpy(zero_copy_only=False)
            for r in range(runs):
                rows, nodes = np.arange(len(sid)), np.full(len(sid), r + 1, np.uint64)
                nodes = W.spread64(nodes)
                for _ in range(FIRST_DEPTH):
                    held = np.repeat(ends[rows] - counts[rows], counts[rows]) + _within(counts[rows])
                    at, nodes = _chosen(nodes, tokens[held], counts[rows])
                    rows = rows[at]
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(sid[rows])], names=["node", "sid"])

    return sketches.select("sid", "sketch").mapInArrow(run, "node long, sid long")


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _deeper(rows: DataFrame) -> DataFrame:
    """One more step for rows of node, sid, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = _tokens(batch.column("sketch"))
            at, nodes = _chosen(batch.column("node").to_numpy().view(np.uint64), tokens, counts)
            took = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *(took.column(c) for c in ("sid", "size", "sketch"))], names=["node", "sid", "size", "sketch"])

    return rows.select("node", "sid", "size", "sketch").mapInArrow(run, "node long, sid long, size int, sketch binary")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of padded sketches, row by row: the share of common ones among the smallest of both."""
    none = np.uint32(0xFFFFFFFF)
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
    real = (both != none) & ~twice
    within = np.cumsum(real, axis=1) <= SKETCH
    return (twice & within).sum(axis=1) / np.maximum((real & within).sum(axis=1), 1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row each row is linked to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    return root


def _bucket_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links inside buckets of bounded size, as a star per group of similar sets. Needs node, sid, size, sketch."""
    least = threshold - MARGIN

    def links(table: pa.Table) -> pa.RecordBatch:
        node, sid, size = (table.column(c).to_numpy() for c in ("node", "sid", "size"))
        tokens, counts = _tokens(table.column("sketch"))
        padded = np.full((len(node), SKETCH), 0xFFFFFFFF, np.uint32)
        padded[np.repeat(np.arange(len(node)), counts), _within(counts)] = tokens
        left, right = [], []
        for k in range(1, len(node)):
            i = np.nonzero(node[k:] == node[:-k])[0]
            if not len(i):
                break
            i = i[(sid[i] != sid[i + k]) & (np.minimum(size[i], size[i + k]) >= threshold * np.maximum(size[i], size[i + k]))]
            for part in np.array_split(i, len(i) // 20_000 + 1):
                part = part[_alike(padded[part], padded[part + k]) >= least] if len(part) else part
                left.append(part)
                right.append(part + k)
        root = _roots(len(node), np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64))
        hangs = np.nonzero(root != np.arange(len(node)))[0]
        pairs = np.unique(np.stack([sid[hangs], sid[root[hangs]]], axis=1), axis=0) if len(hangs) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            node = table.column("node").to_numpy()
            # The last bucket may go on in the next batch.
            cut = int(np.nonzero(node != node[-1])[0][-1]) + 1 if (node != node[-1]).any() else 0
            held = table.slice(cut)
            for lo, hi in _runs(node[:cut], 4096):
                yield links(table.slice(lo, hi - lo).combine_chunks())
        if held is not None:
            yield links(held.combine_chunks())

    dealt = rows.select("node", "sid", "size", "sketch").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "a long, b long")


def _runs(node: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` rows that hold whole buckets of a sorted column."""
    edges = np.concatenate([np.nonzero(np.diff(node))[0] + 1, [len(node)]]) if len(node) else np.zeros(0, np.int64)
    start = 0
    for i, e in enumerate(edges):
        if i + 1 == len(edges) or edges[i + 1] - start > most:
            yield start, int(e)
            start = int(e)


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold two sets or more, with their number ``n``."""
    met = cut_lineage(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
    return cut_lineage(rows.join(met, "node"))


def _led(rows: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Sets ``a`` that stand behind a leader of their node, and the rows that are left, leaders among them; both with the ``leaders`` they are linked to.

    Leaders are drawn by hash, up to ``LEADERS`` for a node, none of which resembles an earlier one. A set behind a leader has left the node. So a
    node of near copies shrinks to a few rows, however large it was. What is similar to a set that left is not far from its leader, as one minus
    the similarity is a distance: every set is linked to all leaders that near, whether it leaves or stays.
    """
    near = threshold - MARGIN
    drawn = [F.min(F.struct(F.xxhash64("sid", "node", F.lit(i)).alias("h"), "sid", "sketch")).alias(f"l{i}") for i in range(LEADERS)]
    leaders = rows.groupBy("node").agg(*drawn).select("node", F.array(*[f"l{i}.sid" for i in range(LEADERS)]).alias("ids"), F.array(*[f"l{i}.sketch" for i in range(LEADERS)]).alias("sketches"))

    def padded(column: pa.Array) -> np.ndarray:
        tokens, counts = _tokens(column)
        out = np.full((len(counts), SKETCH), 0xFFFFFFFF, np.uint32)
        out[np.repeat(np.arange(len(counts)), counts), _within(counts)] = tokens
        return out

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks leaders that resemble no earlier one that stays."""
        for batch in batches:
            n = batch.num_rows
            ids = batch.column("ids").flatten().to_numpy().reshape(n, LEADERS)
            theirs = padded(batch.column("sketches").flatten()).reshape(n, LEADERS, SKETCH)
            stays = np.ones((n, LEADERS), bool)
            for i in range(1, LEADERS):
                for j in range(i):
                    stays[:, i] &= ~(stays[:, j] & ((ids[:, i] == ids[:, j]) | (_alike(theirs[:, i], theirs[:, j]) >= BEHIND)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(stays.ravel()), LEADERS).cast(pa.list_(pa.bool_()))], [*batch.schema.names, "stays"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, own = batch.column("sid").to_numpy(), padded(batch.column("sketch"))
            ids = batch.column("ids").flatten().to_numpy().reshape(-1, LEADERS)
            stays = batch.column("stays").flatten().to_numpy(zero_copy_only=False).reshape(-1, LEADERS)
            theirs = padded(batch.column("sketches").flatten()).reshape(-1, LEADERS, SKETCH)
            close, behind = np.zeros((len(sid), LEADERS), bool), np.zeros(len(sid), bool)
            leads = ((ids == sid[:, None]) & stays).any(axis=1)
            for i in range(LEADERS):
                at = np.nonzero(stays[:, i] & ~leads)[0]
                if len(at):
                    like = _alike(own[at], theirs[at, i])
                    close[at, i] = like >= near
                    behind[at[like >= BEHIND]] = True
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(close.sum(axis=1))]), pa.int32()), pa.array(ids[close], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "sid", "size", "sketch")), lists, pa.array(behind)], ["node", "sid", "size", "sketch", "leaders", "behind"])

    leaders = leaders.mapInArrow(apart, "node long, ids array<long>, sketches array<binary>, stays array<boolean>")
    joined = rows.select("node", "sid", "size", "sketch").join(leaders, "node")
    judged = cut_lineage(joined.mapInArrow(judge, "node long, sid long, size int, sketch binary, leaders array<long>, behind boolean"))
    return judged.filter("behind").select(F.col("sid").alias("a"), "leaders"), judged.filter("not behind").drop("behind")


def _candidate_links(sketches: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links that connect all sets a pair of which met in some bucket and looks similar."""
    paths = _first_paths(sketches, runs_for(recall, threshold))
    met = cut_lineage(paths.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = cut_lineage(paths.join(met, "node").join(sketches.select("sid", "size", "sketch"), "sid"))
    found = _bucket_links(rows.filter(F.col("n") <= BUCKET), threshold)
    large = rows.filter(F.col("n") > BUCKET)
    for depth in range(FIRST_DEPTH, MOST_DEPTH + 1):
        if large.isEmpty():
            return found
        links, left = _led(large, threshold)
        rows = _counted(left.drop("leaders"))
        near = cut_lineage(links.unionByName(left.select(F.col("sid").alias("a"), "leaders")).filter(F.size("leaders") > 0))
        # A set hangs on one leader; leaders near the same set hang on each other, once for all sets that are near the same ones.
        found = found.unionByName(near.select("a", F.array_min("leaders").alias("b"))).unionByName(_star(near.select("leaders").distinct(), "leaders")).unionByName(_bucket_links(rows.filter(F.col("n") <= BUCKET), threshold))
        large = rows.filter(F.col("n") > BUCKET)
        if depth < MOST_DEPTH:
            rows = _counted(cut_lineage(_deeper(large)))
            found = found.unionByName(_bucket_links(rows.filter(F.col("n") <= BUCKET), threshold))
            large = rows.filter(F.col("n") > BUCKET)
    # What still is large has few near copies left: it is dealt into blocks, and every block meets every other in a node of their own.
    blocks = F.ceil(F.col("n") / (4 * BUCKET))
    home = F.pmod(F.xxhash64("node", "sid"), blocks)
    dealt = large.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumn("node", F.xxhash64("node", F.least("home", "other"), F.greatest("home", "other")))
    return found.unionByName(_bucket_links(dealt, threshold))


def _star(rows: DataFrame, column: str) -> DataFrame:
    """Links ``a`` and ``b`` of the least of a list of sets with each other one."""
    return rows.select(F.array_min(column).alias("a"), F.explode(column).alias("b")).filter("a < b").distinct()


def _thinned(links: DataFrame) -> DataFrame:
    """Links that connect the same sets: of all that ``a`` hangs on it keeps the least, on which the others hang instead.

    A large group is met in many buckets or blocks, in each with another root. So its links outnumber its sets by the number of
    these; here they are about one for each set. A list has as many entries as buckets or blocks its set was met in.
    """
    held = cut_lineage(links.groupBy("a").agg(F.collect_set("b").alias("on")))
    return held.select("a", F.array_min("on").alias("b")).unionByName(_star(held, "on"))


def _verified(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """Exact links inside tasks. Rows: job, group, side (0, 1, or 2 for both), sid, text; a pair counts if it is of one group
    and its sides are 0 and 1, or both 2. Returns sid, n_links and root, a smallest set of its own side or the other linked to it."""

    def links(table: pa.Table) -> pa.Table:
        group, side, sid = (table.column(c).to_numpy() for c in ("group", "side", "sid"))
        order = np.lexsort((sid, group))
        group, side, sid = group[order], side[order], sid[order]
        sets = shingle_sets(W.filled(table.column("text").take(pa.array(order))), width)
        counts, roots = np.zeros(len(sid), np.int64), np.arange(len(sid))
        edges = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(group)]]) if len(group) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            size = np.array([len(s) for s in sets[lo:hi]])
            row, (values, column) = np.repeat(np.arange(hi - lo), size), np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
            used = np.bincount(column, minlength=len(values))
            place = np.cumsum(used > 1) - 1
            row, column = row[used[column] > 1], place[column[used[column] > 1]]
            common = np.zeros((hi - lo, hi - lo), np.float32)
            wide = max(1, (4 << 20) // (hi - lo))
            by = np.argsort(column, kind="stable")
            row, column = row[by], column[by]
            for start in range(0, int((used > 1).sum()), wide):
                a, b = np.searchsorted(column, [start, start + wide])
                part = np.zeros((hi - lo, wide), np.float32)
                part[row[a:b], column[a:b] - start] = 1
                common += part @ part.T
            total = size[:, None] + size[None, :]
            close = common * (1 + threshold) >= threshold * total - 1e-6
            s = side[lo:hi]
            close &= ((s[:, None] + s[None, :]) == 1) | ((s[:, None] == 2) & (s[None, :] == 2))
            np.fill_diagonal(close, False)
            counts[lo:hi] = close.sum(axis=1)
            a, b = np.nonzero(close)
            roots[lo:hi] = lo + _roots(hi - lo, a, b)
        return pa.table({"sid": sid, "n_links": counts, "root": sid[roots], "group": group})

    return members.groupBy("job").applyInArrow(links, "sid long, n_links long, root long, group long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Classes of texts whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold`` or more, linked or by a chain.

    Returns key, class_id (the smallest key of the class), n_links (different sets linked to the text's own), n_copies
    (rows with the same set), is_first (whether the row is the one that stands for its class; rows that repeat it are too) and mark, a hash
    of the text. Sets that are equal are one from the start. A set walks down random trees: at a node it
    goes to the children named by tokens that a hash of the node and the token samples, so similar sets meet in buckets and others
    part. Buckets of up to ``BUCKET`` sets are compared by sketches. In larger ones near copies first go behind a leader, the rest is split further, and
    what stays large is compared block by block at last; ``runs_for`` gives the number of trees for ``recall``. Sets that the links connect are then compared
    exactly, large groups in pairs of blocks. A link is an exact statement; one is missed with probability 1 - ``recall`` at most at
    the threshold, less above it. Sets are known by 64-bit hashes.

    Null texts and texts without words are classes of their own. Rows may repeat; a null key is a row like any other and
    never the class id of a class with a key. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    seen = cut_lineage(_sketches(rows, width))
    sets = seen.filter("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("first"), F.count("*").alias("n_copies"), F.max("n_bytes").alias("n_bytes"))
    sets = cut_lineage(sets.select("sid", "first.key", "first.mark", "n_copies", "n_bytes"))
    sketches = cut_lineage(seen.filter("sid is not null").select("sid", "size", "sketch").distinct())
    near = connected(_thinned(_candidate_links(sketches, threshold, recall)))
    groups = near.join(sets, near.node == sets.sid).select("sid", "root", "key", "mark", "n_bytes")
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks"), F.sum("n_bytes").alias("bytes"))
    groups = cut_lineage(groups.join(sizes, "root"))
    total = groups.agg(F.sum("n_bytes").alias("b")).first().b or 0
    jobs = max(64, total // (BLOCK_BYTES // 4))
    home = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    # Block i meets block j in the job (i, j); a set of block i has side 0 there if i < j, 1 if i > j, and 2 in (i, i).
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = groups.withColumn("home", home).withColumn("other", other).select(
        "sid", F.col("root").alias("group"), "blocks",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(jobs))).otherwise(F.xxhash64("root", F.least("home", "other"), F.greatest("home", "other"))).alias("job"),
        F.when(F.col("home") == F.col("other"), 2).when(F.col("home") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    # One text of each set, that of its smallest key; rows that repeat it count once. The groups grow with the texts, so they are never broadcast.
    same = rows["key"].eqNullSafe(groups["key"]) & (rows["mark"] == groups["mark"])
    texts = groups.hint("merge").join(rows, same).select("sid", "text").dropDuplicates(["sid"])
    checked = cut_lineage(_verified(dealt.join(texts, "sid").select("job", "group", "side", "sid", "text"), width, threshold))
    links = checked.groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    classes = connected(_thinned(checked.select(F.col("sid").alias("a"), F.col("root").alias("b"))))
    known = (
        sets.select("sid", F.struct(F.col("key").isNull().alias("none"), "key", "mark").alias("least"), "n_copies").join(links, "sid", "left").join(classes.select(F.col("node").alias("sid"), "root"), "sid", "left")
        .select("sid", "least", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "sid").alias("root"))
    )
    first = known.groupBy("root").agg(F.min("least").alias("first"))
    known = cut_lineage(known.join(first, "root").select("sid", "first.key", "first.mark", "n_links", "n_copies").toDF("sid", "class_id", "first_mark", "n_links", "n_copies"))
    alone = F.col("sid").isNull()
    return seen.select("key", "mark", "sid").join(known, "sid", "left").select(
        F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | (F.col("key").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("first_mark")))).alias("is_first"), "mark",
    )

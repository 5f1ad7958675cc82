"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import exchange as X
from tabflow.llm import words as W
from tabflow.session import cut_lineage

# Words of each class of frequent words, the most frequent first; all other words fall into SHAPES classes by their form, and there down a
# tree over the digits of their hashes, DIGIT bits at a time.
CLASSES = (1, 1, 1, 1, 2, 2, 4, 4, 8, 16, 16, 16, 16, 16, 16, 16)
SHAPES = 4
# Bits of the hashed features: previous word, previous two words, word before the previous (the skip); the last two again inside classes.
BITS, INNER_BITS = 12, 9
# Bits of the hashed features of the nodes of these trees: node with previous word, node with the word before the previous.
DIGIT, DEEP_BITS = 4, 16
# Bytes of text for which trees of one level are enough; each further level serves 2 ** DIGIT times as many.
LEVEL_BYTES = 1 << 17
SLOTS = max(CLASSES)
OUTER_ROWS, INNER_ROWS = 1 + 3 * (1 << BITS), 1 + 2 * (1 << INNER_BITS)
# Tokens of a gradient step, step size, rounds of local steps and averaging.
BATCH, RATE, ROUNDS = 8192, 0.15, 2
SMOOTH = 0.1
BLOCK_BYTES = 1 << 20
# Hashes of what stands before a text and after it.
BEFORE, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A3F6B)
CHUNK = 1 << 15


@dataclass
class Tokens:
    """Tokens of some texts: numbers into the distinct ones, of which the last is the end."""

    codes: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    shapes: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    flat, starts = W.split_words(pc.ascii_lower(texts))
    codes, distinct = W.coded(flat)
    hashes = np.concatenate([W.word_hashes(distinct), [END]])
    data, at = W.raw_bytes(distinct.cast(pa.large_string())) if len(distinct) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    wide = W.per_text(data >= 128, at) > 0
    marked = np.isin(data[at[1:] - 1], np.frombuffer(b".,;:!?", np.uint8)) if len(distinct) else np.zeros(0, bool)
    shapes = np.concatenate([wide * 2 + marked, [0]]).astype(np.int64)
    n = len(starts) - 1
    ends = starts + np.arange(n + 1)
    all_codes = np.full(len(codes) + n, len(distinct), np.int64)
    word = np.ones(len(all_codes), bool)
    word[ends[1:] - 1] = False
    all_codes[word] = codes
    return Tokens(all_codes, ends, hashes, shapes)


@dataclass
class Vocabulary:
    """Counts of all tokens, and of the classes. Frequent words are known by their hashes, ascending."""

    total: int
    distinct: int
    heads: np.ndarray
    head_class: np.ndarray
    head_slot: np.ndarray
    sizes: np.ndarray
    rest_total: np.ndarray
    rest_distinct: np.ndarray
    # Trees of the other words: levels; for every node (levels one after the other) its children's shares by smoothed counts; counts and words of the cells below the last level.
    depth: int
    prior: np.ndarray
    cell_total: np.ndarray
    cell_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.sizes) + SHAPES

    def place(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of each distinct token; slot -1 in the classes by form."""
        if not len(self.heads):
            return len(self.sizes) + t.shapes, np.full(len(t.hashes), -1)
        at = np.minimum(np.searchsorted(self.heads, t.hashes), len(self.heads) - 1)
        head = self.heads[at] == t.hashes
        return np.where(head, self.head_class[at], len(self.sizes) + t.shapes), np.where(head, self.head_slot[at], -1)

    def deep(self, cell: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes on the paths to cells, one level after the other, the digits taken there, and the rows of the deep weights, one column per feature."""
        paths = [cell >> (DIGIT * (self.depth - level)) for level in range(self.depth + 1)]
        base = np.cumsum([0, *(SHAPES << (DIGIT * level) for level in range(self.depth))])
        node = np.concatenate([p + b for p, b in zip(paths[:-1], base, strict=False)])
        digit = np.concatenate(paths[1:]) & ((1 << DIGIT) - 1)
        mark = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = lambda x: (W.spread64(np.tile(x, self.depth) ^ mark) >> np.uint64(64 - DEEP_BITS)).astype(np.int64)
        return node, digit, np.stack([bucket(one), bucket(two * np.uint64(0x94D049BB133111EB) + np.uint64(1))], axis=1)


def cells(shapes: np.ndarray, hashes: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of words by form and the first ``depth`` digits of their hashes."""
    first = (hashes >> np.uint64(64 - DIGIT * depth)).astype(np.int64) if depth else np.zeros(len(hashes), np.int64)
    return (shapes.astype(np.int64) << (DIGIT * depth)) + first


def levels(total_bytes: int) -> int:
    """Levels of the trees for texts of that size, so that few words share a cell."""
    n = 1
    while LEVEL_BYTES << (DIGIT * n) < total_bytes:
        n += 1
    return n


@dataclass
class Weights:
    outer: np.ndarray
    inner: np.ndarray
    deep: np.ndarray

    @classmethod
    def zero(cls, v: Vocabulary) -> Weights:
        return cls(np.zeros((OUTER_ROWS, v.classes), np.float32), np.zeros((len(v.sizes) * INNER_ROWS, SLOTS), np.float32), np.zeros((1 << DEEP_BITS, 1 << DIGIT), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.outer.ravel(), self.inner.ravel(), self.deep.ravel()])

    def filled(self, flat: np.ndarray) -> Weights:
        own = (self.outer, self.inner, self.deep)
        parts = np.split(flat, np.cumsum([x.size for x in own])[:-1])
        return Weights(*(part.reshape(x.shape).astype(np.float32) for part, x in zip(parts, own, strict=True)))


def before(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before each token and of the one before that."""
    h = t.hashes[t.codes]
    first = np.zeros(len(h) + 2, bool)
    first[t.starts[:-1]] = True
    one = np.concatenate([[BEFORE], h[:-1]]) if len(h) else h
    one[first[: len(h)]] = BEFORE
    two = np.concatenate([[BEFORE], one[:-1]]) if len(h) else h
    two[first[: len(h)]] = BEFORE
    return one, two


def contexts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Rows of the outer weights for each token, one column per feature besides the bias."""
    shift = np.uint64(64 - BITS)
    bucket = lambda x: (W.spread64(x) >> shift).astype(np.int64)
    return np.stack([1 + bucket(one), 1 + (1 << BITS) + bucket(one * np.uint64(0x9E3779B97F4A7C15) + two), 1 + (2 << BITS) + bucket(two ^ np.uint64(0x94D049BB133111EB))], axis=1)


def inner_rows(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the inner weights for tokens of frequent classes: the bias of the class, previous word, skip."""
    drop = BITS - INNER_BITS
    base = classes * INNER_ROWS
    return np.stack([base, base + 1 + ((rows[:, 0] - 1) >> drop), base + 1 + (1 << INNER_BITS) + ((rows[:, 2] - 1 - (2 << BITS)) >> drop)], axis=1)


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def outer_share(w: Weights, rows: np.ndarray) -> np.ndarray:
    scores = w.outer.take(rows[:, 0], axis=0)
    scores += w.outer.take(rows[:, 1], axis=0)
    scores += w.outer.take(rows[:, 2], axis=0)
    scores += w.outer[0]
    return _softmax(scores)


def inner_share(w: Weights, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    scores = w.inner.take(rows[:, 0], axis=0)
    scores += w.inner.take(rows[:, 1], axis=0)
    scores += w.inner.take(rows[:, 2], axis=0)
    scores[np.arange(SLOTS) >= sizes[:, None]] = -1e30
    return _softmax(scores)


def deep_share(w: Weights, v: Vocabulary, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Shares of the children of nodes: by their counts where the weights are 0."""
    scores = w.deep.take(rows[:, 0], axis=0)
    scores += w.deep.take(rows[:, 1], axis=0)
    # Shares by counts add up to 1, so no row is all 0 and none overflows.
    np.exp(np.clip(scores, -40, 40, out=scores), out=scores)
    scores *= v.prior.take(node, axis=0)
    scores /= (scores @ np.ones(scores.shape[1], np.float32))[:, None]
    return scores


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
    """One step on the rows in use, each feature with its own step size."""
    # Sixteen bits are sorted faster.
    kind = np.uint16 if len(weights) <= 1 << 16 else rows.dtype
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k].astype(kind), kind="stable")
        ordered = rows[order, k]
        at = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0]
        used, total = rows[order[at], k], np.add.reduceat(slope.take(order, axis=0), at, axis=0)
        seen = squares.take(used, axis=0)
        seen += total * total
        squares[used] = seen
        np.sqrt(seen, out=seen)
        total *= RATE
        total /= seen
        weights[used] -= total


def learn(w: Weights, squares: Weights, v: Vocabulary, t: Tokens) -> None:
    """Gradient steps over the tokens, in place."""
    one, two = before(t)
    rows = contexts(one, two)
    of, slot = v.place(t)
    classes, slots = of[t.codes], slot[t.codes]
    cell = cells(t.shapes, t.hashes, v.depth)
    for lo in range(0, len(classes), BATCH):
        r, c, s = rows[lo : lo + BATCH], classes[lo : lo + BATCH], slots[lo : lo + BATCH]
        slope = outer_share(w, r)
        slope[np.arange(len(c)), c] -= 1
        bias = slope.sum(axis=0)
        squares.outer[0] += bias * bias
        w.outer[0] -= RATE * bias / np.sqrt(squares.outer[0])
        _descend(w.outer, squares.outer, r, slope)
        head = np.nonzero(s >= 0)[0]
        head = head[v.sizes[c[head]] > 1] if len(head) else head
        if len(head):
            inner = inner_rows(r[head], c[head])
            slope = inner_share(w, inner, v.sizes[c[head]])
            slope[np.arange(len(head)), s[head]] -= 1
            _descend(w.inner, squares.inner, inner, slope)
        tail = np.nonzero(s < 0)[0]
        if len(tail):
            node, digit, deep = v.deep(cell[t.codes[lo + tail]], one[lo + tail], two[lo + tail])
            slope = deep_share(w, v, node, deep)
            slope[np.arange(len(digit)), digit] -= 1
            _descend(w.deep, squares.deep, deep, slope)


def token_scores(w: Weights, v: Vocabulary, t: Tokens, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each token after those before it; ``counts`` are those of the distinct tokens."""
    one, two = before(t)
    rows = contexts(one, two)
    of, slot = v.place(t)
    rest = np.zeros(len(of))
    tail = slot < 0
    shape = of[tail] - len(v.sizes)
    # The room for tokens never seen is that of one of them by form; the others share what is left down to their cell, and there by counts.
    room = SMOOTH / (v.rest_total[shape] + SMOOTH * (v.rest_distinct[shape] + 1))
    cell, known = cells(t.shapes, t.hashes, v.depth), counts[tail] > 0
    share = (counts[tail] + SMOOTH) / np.where(known, v.cell_total[cell[tail]] + SMOOTH * v.cell_distinct[cell[tail]], 1)
    rest[tail] = np.log10(np.where(known, (1 - room) * share, room))
    deeper = tail & (counts > 0)
    classes, slots = of[t.codes], slot[t.codes]
    out = rest[t.codes]
    for lo in range(0, len(classes), BATCH):
        r, c, s = rows[lo : lo + BATCH], classes[lo : lo + BATCH], slots[lo : lo + BATCH]
        part = out[lo : lo + BATCH]
        part += np.log10(outer_share(w, r)[np.arange(len(c)), c], dtype=np.float64)
        head = np.nonzero(s >= 0)[0]
        head = head[v.sizes[c[head]] > 1] if len(head) else head
        if len(head):
            part[head] += np.log10(inner_share(w, inner_rows(r[head], c[head]), v.sizes[c[head]])[np.arange(len(head)), s[head]], dtype=np.float64)
        codes = t.codes[lo : lo + BATCH]
        down = np.nonzero(deeper[codes])[0]
        if len(down):
            node, digit, deep = v.deep(cell[codes[down]], one[lo + down], two[lo + down])
            steps = np.log10(deep_share(w, v, node, deep)[np.arange(len(digit)), digit], dtype=np.float64)
            part[down] += steps.reshape(v.depth, -1).sum(axis=0)
    return out


def _counts(dealt: DataFrame, buckets: int, depth: int = 1) -> DataFrame:
    """Training counts of every block's distinct tokens, and of each bucket the totals by form and by cell, and the most frequent tokens.

    Rows of kind 0: block, base, counts in order of the block's ascending hashes from base on. Of kind 1: one per bucket.
    """

    def send(table: pa.Table) -> pa.Table:
        t = tokens(W.filled(table.column("text")))
        used = np.repeat(table.column("learn").to_numpy(zero_copy_only=False), np.diff(t.starts))
        n = np.bincount(t.codes[used], minlength=len(t.hashes))
        order = np.argsort(t.hashes)
        bucket, at = X.cut(t.hashes[order], buckets)
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": bucket, "block": pa.array(np.full(len(at), block)), "base": pa.array(at.astype(np.int64)), "hashes": X.packed(t.hashes[order], at),
                         "n": X.packed(n[order].astype(np.uint32), at), "shapes": X.packed(t.shapes[order].astype(np.uint8), at)})

    def answer(table: pa.Table) -> pa.Table:
        (hashes, sizes), (n, _), (shapes, _) = X.held(table.column("hashes"), "<u8"), X.held(table.column("n"), "<u4"), X.held(table.column("shapes"), "u1")
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(number, n, minlength=len(distinct)).astype(np.int64)
        shape = shapes[first]
        by_shape = np.bincount(shape, total, minlength=SHAPES).astype(np.int64)
        kinds = np.bincount(shape[total > 0], minlength=SHAPES)
        cell, of = np.unique(cells(shape, distinct, depth)[total > 0], return_inverse=True)
        by_cell = np.stack([cell, np.bincount(of, total[total > 0], len(cell)).astype(np.int64), np.bincount(of, minlength=len(cell))])
        top = np.lexsort((distinct, -total))[: sum(CLASSES) + 1]
        # The end has a place of its own however rare it is.
        ends = np.nonzero(distinct == END)[0]
        top = np.concatenate([top, ends[~np.isin(ends, top)]])
        top = top[total[top] > 0]
        at = np.cumsum(sizes) - sizes
        rows = len(sizes)
        none = pa.array([None], pa.binary())
        return pa.table({
            "kind": pa.array([0] * rows + [1], pa.int32()), "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.array([None], pa.int64())]),
            "base": pa.concat_arrays([table.column("base").combine_chunks(), pa.array([None], pa.int64())]),
            "counts": pa.concat_arrays([X.packed(total[number], at), none]),
            "by_shape": pa.array([None] * rows + [by_shape.tolist()], pa.list_(pa.int64())), "kinds": pa.array([None] * rows + [kinds.tolist()], pa.list_(pa.int64())),
            "top": pa.array([None] * rows + [[{"hash": int(h), "n": int(c), "shape": int(s)} for h, c, s in zip(distinct[top].view(np.int64), total[top], shape[top], strict=True)]],
                            pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64()), ("shape", pa.int32())]))),
            "depth": pa.array([None] * rows + [depth], pa.int32()), "cells": pa.array([None] * rows + [by_cell.astype("<i8").tobytes()], pa.binary()),
        })

    sent = dealt.groupBy("block").applyInArrow(send, "bucket long, block long, base long, hashes binary, n binary, shapes binary")
    return sent.groupBy("bucket").applyInArrow(
        answer, "kind int, block long, base long, counts binary, by_shape array<long>, kinds array<long>, top array<struct<hash:long,n:long,shape:int>>, depth int, cells binary")


def vocabulary(counted: DataFrame) -> Vocabulary:
    """Totals of all buckets, classes of the most frequent tokens (the end is always among those), and trees of all others."""
    each = counted.filter("kind = 1")
    sums = each.agg(*[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)).alias(f"{c}{i}") for c in ("by_shape", "kinds") for i in range(SHAPES)]).first()
    rest = np.array([sums[f"by_shape{i}"] for i in range(SHAPES)], np.int64)
    kinds = np.array([sums[f"kinds{i}"] for i in range(SHAPES)], np.int64)
    total, distinct = int(rest.sum()), int(kinds.sum())
    tops = each.select(F.explode("top").alias("t")).select("t.*")
    top = [(r.hash, r.n, r["shape"]) for r in tops.orderBy(F.desc("n"), "hash").limit(sum(CLASSES)).collect()]
    end = int(END.astype(np.int64))
    if top and all(h != end for h, _, _ in top):
        top[-1:] = [(r.hash, r.n, r["shape"]) for r in tops.filter(F.col("hash") == end).collect()] or top[-1:]
    sizes, at, place = [], 0, []
    for size in CLASSES:
        words = top[at : at + size]
        if words:
            place += [(h, len(sizes), k) for k, (h, _, _) in enumerate(words)]
            sizes.append(len(words))
        at += size
    for _, n, shape in top:
        rest[shape] -= n
        kinds[shape] -= 1
    depth = each.agg(F.max("depth")).first()[0] or 1
    cell_total, cell_distinct = (np.zeros(SHAPES << (DIGIT * depth), np.int64) for _ in range(2))
    for r in each.select("cells").toLocalIterator():
        cell, n, kind = np.frombuffer(r.cells, "<i8").reshape(3, -1)
        cell_total[cell] += n
        cell_distinct[cell] += kind
    for h, n, shape in top:
        cell = cells(np.array([shape]), np.array([h]).view(np.uint64), depth)
        cell_total[cell] -= n
        cell_distinct[cell] -= 1
    mass, prior = cell_total + SMOOTH * cell_distinct, []
    for _ in range(depth):
        mass = mass.reshape(-1, 1 << DIGIT)
        whole = mass.sum(axis=1)
        # Empty nodes are on no path; equal shares keep them finite.
        prior.insert(0, np.where(whole[:, None] > 0, mass / np.where(whole > 0, whole, 1)[:, None], 1 / (1 << DIGIT)).astype(np.float32))
        mass = whole
    place.sort(key=lambda p: p[0] % (1 << 64))
    column = lambda i, kind: np.array([p[i] for p in place], kind)
    return Vocabulary(total, distinct, column(0, np.int64).view(np.uint64), column(1, np.int64), column(2, np.int64), np.array(sizes, np.int64), rest, kinds,
                      depth, np.concatenate(prior), cell_total, cell_distinct)


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` of local gradient steps on all texts, averaged over the tasks by their tokens.

    A round starts from the average of the one before. Sums are made in two steps, so a task adds up few of the parts however many there are.
    """
    spark, w = docs.sparkSession, Weights.zero(v)
    if not v.total:
        return w

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((w, v))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start, vocab = sent.value
            own = Weights(start.outer.copy(), start.inner.copy(), start.deep.copy())
            squares = Weights(*(np.full_like(x, 1.0) for x in (own.outer, own.inner, own.deep)))
            n = 0
            for whole in batches:
                for batch in W.steps(whole, "text"):
                    t = tokens(W.filled(batch.column("text")))
                    learn(own, squares, vocab, t)
                    n += len(t.codes)
            if n:
                flat = own.flat().astype(np.float64) * n
                at = np.arange(0, len(flat), CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(at)), pa.int32()), pa.array(np.full(len(at), TaskContext.get().partitionId() // 16), pa.int32()), pa.array(np.full(len(at), n), pa.int64()),
                     X.packed(flat.astype(np.float32), at)], names=["chunk", "part", "n", "sums"])

        def added(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x, "<f4") for x in table.column("sums").to_pylist()]
            total = np.sum(parts, axis=0, dtype=np.float64).astype(np.float32)
            return pa.table({"chunk": table.column("chunk")[:1], "part": pa.array([0], pa.int32()), "n": [pc.sum(table.column("n")).as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

        schema = "chunk int, part int, n long, sums binary"
        parts = docs.select("text").mapInArrow(run, schema)
        whole = parts.groupBy("chunk", "part").applyInArrow(added, schema).groupBy("chunk").applyInArrow(added, schema)
        rows = sorted(whole.collect(), key=lambda r: r.chunk)
        if rows:
            w = w.filled(np.concatenate([np.frombuffer(r["sums"], "<f4") / r.n for r in rows]))
    return w


def lm_scores(docs: DataFrame, learn: str = "learn", key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Unigram and model scores (log10 probabilities) of every whole text, learnt from the rows where ``learn`` is true.

    A token's class is predicted from hashed features of the previous word, the previous two and the one before the previous; a
    frequent token's place in its class from the same without the pair. Any other token is reached in its class by the digits of its hash: every
    digit is predicted from hashed features of the node with the previous word and with the one before, starting from the smoothed counts below,
    and the few tokens of a cell share it by their counts. Levels grow with the texts. There is room for one token never seen.
    All probabilities of a place add up to 1. Counts cover all learnt texts: blocks of about
    ``block_bytes`` of text send their distinct tokens by hash and get the counts back, a token once per block. Weights have a fixed size.

    Null texts are empty: one token, the end. Repeated rows count as often. A null in ``learn`` is false. With nothing learnt
    every known count is 0 and all classes are alike. Returns key, ``keep``, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    blocks, buckets = X.layout(size, block_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
    counted = cut_lineage(_counts(dealt.select("block", "text", "learn").repartition("block"), buckets, levels(size)))
    v = vocabulary(counted)
    sent = spark.sparkContext.broadcast((train(rows.filter("learn"), v, rounds), v))
    carried = ["key", *(f"keep{i}" for i in range(len(keep)))]
    names = [*carried, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], table.schema.field(c).type) for c in carried] + [pa.array([], x) for x in (pa.int64(),) * 3 + (pa.float64(),) * 2], names=names)
        w, vocab = sent.value
        t = tokens(W.filled(table.column("text")))
        order = np.argsort(t.hashes)
        counts = np.zeros(len(t.hashes), np.int64)
        for base, part in zip(replies.column("base").to_pylist(), replies.column("counts").to_pylist(), strict=True):
            n = np.frombuffer(part, "<i8")
            counts[order[base : base + len(n)]] = n
        base = np.log10((counts + SMOOTH) / (vocab.total + SMOOTH * (vocab.distinct + 1)))
        add = lambda x: np.add.reduceat(x, t.starts[:-1])
        out = [np.diff(t.starts), add((counts > 0)[t.codes].astype(np.int64)), np.full(table.num_rows, vocab.total, np.int64), add(base[t.codes]), add(token_scores(w, vocab, t, counts))]
        return pa.table([*(table.column(c) for c in carried), *map(pa.array, out)], names=names)

    replies = counted.filter("kind = 0").select("block", "base", "counts")
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    out = dealt.select("block", "text", *carried).repartition("block").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scored, schema)
    return out.select(F.col("key").alias(key), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], *names[len(carried):])

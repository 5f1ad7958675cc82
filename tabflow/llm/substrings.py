"""Substring dedup: windows of words that occur earlier, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import exchange as X
from tabflow.llm import words as W

# Every difference modulo PERIOD is a difference of two members of COVER (fixed values). So for any two positions there is
# a shift below PERIOD that moves both onto members.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
# Bytes of text a task looks at together, on average.
BLOCK_BYTES = 1 << 20
LAST = np.iinfo(np.int64).max


class Block:
    """Words, anchors and windows of the texts of one block."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.part = window, window - PERIOD + 1
        self.flat, self.starts = W.split_words(W.filled(table.column("text")))
        codes, distinct = W.coded(self.flat)
        self.hashes = W.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        sizes = np.diff(self.starts)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.doc)) - self.starts[:-1][self.doc]
        self.left = sizes[self.doc] - self.place
        key = table.column("key").combine_chunks() if isinstance(table.column("key"), pa.ChunkedArray) else table.column("key")
        # A row without a key is later than all others.
        self.keys = pc.fill_null(key, LAST).to_numpy(zero_copy_only=False)
        covered = np.zeros(PERIOD, bool)
        covered[list(COVER)] = True
        at = np.nonzero(covered[self.place % PERIOD] & (self.left >= self.part) & (sizes[self.doc] >= window))[0]
        self.anchor_at = at
        found = W.rolling(self.hashes, self.part)[at] if len(at) else np.zeros(0, np.uint64)
        self.anchors, self.anchor, times = np.unique(found, return_inverse=True, return_counts=True)
        self.twice = times > 1

    def near(self, marked: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor marked in ``marked`` (by its number)."""
        hit = np.zeros(len(self.doc) + PERIOD + 1, np.int64)
        hit[self.anchor_at[marked[self.anchor]] + 1] = 1
        total = np.cumsum(hit)
        start = np.nonzero(self.left >= self.window)[0]
        return start[total[start + PERIOD] > total[start]]

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows at ``start``."""
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        other = W.rolling(W.spread64(self.hashes ^ np.uint64(0x5851F42D4C957F2D)), self.window, 0xDA942042E4DD58B5)
        return W.rolling(self.hashes, self.window)[start], (other[start] >> np.uint64(32)).astype(np.uint32)

    def sent(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different windows near marked anchors in order of their hash, their least key, and for each such start its window."""
        start = self.near(marked)
        big, small = self.windows(start)
        key = self.keys[self.doc[start]]
        order = np.lexsort((key, small, big))
        new = np.ones(len(order), bool)
        new[1:] = (big[order][1:] != big[order][:-1]) | (small[order][1:] != small[order][:-1])
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return big[first], small[first], key[first], start, number

    def removed(self, remote: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Marks words in windows that occur earlier; ``earlier`` numbers windows of ``sent`` that do so in another block."""
        n = len(self.doc)
        gone = np.zeros(n + 1, np.int64)
        _, _, _, start, number = self.sent(remote)
        if len(earlier):
            flag = np.zeros(number.max() + 1, bool)
            flag[earlier] = True
            hit = start[flag[number]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + self.window, -1)
        start = self.near(self.twice)
        big, small = self.windows(start)
        key, doc = self.keys[self.doc[start]], self.doc[start]
        order = np.lexsort((start, doc, key, small, big))
        b, s, k, d = big[order], small[order], key[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
        if len(order):
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            again = k > k[first]
            again[1:] |= ~new[1:] & (d[1:] == d[:-1])
            hit = start[order[again]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + self.window, -1)
        return np.cumsum(gone)[:n] > 0


def _replies(block: np.ndarray, base: np.ndarray, sizes: np.ndarray, hit: np.ndarray) -> pa.Table:
    """For rows of ``sizes`` values, the numbers of the hit values, one row for each row with a hit."""
    row = np.repeat(np.arange(len(sizes)), sizes)[hit]
    number = (base[row] + hit - (np.cumsum(sizes) - sizes)[row]).astype(np.uint32)
    at = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0] if len(row) else np.zeros(0, np.int64)
    return pa.table({"block": pa.array(block[row[at]], pa.int64()), "numbers": X.packed(number, at)})


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Every whole text without the words of its windows that start earlier: in a row of smaller key, or earlier in the same row.

    Texts are dealt into blocks of about ``block_bytes``. A block hashes runs of ``window - PERIOD + 1`` words only at the
    positions of the cover; two equal windows always share such an anchor. Anchors are dealt by hash, and those of
    two blocks or more are reported back. Only windows that hold one are hashed whole (96 bits), dealt by hash, and where another
    block has a smaller key, reported back. A block sends each anchor and window once, however often it holds it, so what meets in
    one task is bounded by the number of blocks. Texts are shuffled once.

    Returns key, n_words, n_removed, kept_sha256 (kept words joined by one space), and with ``with_text`` the kept text.
    Null is a text without words. Rows of equal keys are documents of their own, none earlier than the other; a null key is later
    than any other. Keys are integers. Other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"window is at least {PERIOD}")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    blocks, buckets = X.layout(size, block_bytes)
    # Repeated rows are dealt out, too.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(blocks))).repartition("block")

    def anchors(table: pa.Table) -> pa.Table:
        found = Block(table, window).anchors
        bucket, at = X.cut(found, buckets)
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": bucket, "block": pa.array(np.full(len(at), block)), "base": pa.array(at.astype(np.int64)), "hashes": X.packed(found, at)})

    def shared(table: pa.Table) -> pa.Table:
        values, sizes = X.held(table.column("hashes"), "<u8")
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return _replies(table.column("block").to_numpy(), table.column("base").to_numpy(), sizes, np.sort(order[twice]))

    def marked(block: Block, replies: pa.Table) -> np.ndarray:
        out = np.zeros(len(block.anchors), bool)
        out[X.held(replies.column("numbers"), "<u4")[0]] = True
        return out

    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        if not table.num_rows:
            big, small, least, block = empty.view(np.uint64), empty.view(np.uint32), empty, 0
        else:
            own = Block(table, window)
            big, small, least, _, _ = own.sent(marked(own, replies))
            block = table.column("block")[0].as_py()
        bucket, at = X.cut(big, buckets)
        return pa.table({"bucket": bucket, "block": pa.array(np.full(len(at), block, np.int64)), "base": pa.array(at.astype(np.int64)),
                         "big": X.packed(big, at), "small": X.packed(small, at), "least": X.packed(least, at)})

    def later(table: pa.Table) -> pa.Table:
        (big, sizes), (small, _), (least, _) = X.held(table.column("big"), "<u8"), X.held(table.column("small"), "<u4"), X.held(table.column("least"), "<i8")
        order = np.lexsort((least, small, big))
        new = np.ones(len(order), bool)
        new[1:] = (big[order][1:] != big[order][:-1]) | (small[order][1:] != small[order][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        hit = order[least[order] > least[order][first]]
        return _replies(table.column("block").to_numpy(), table.column("base").to_numpy(), sizes, np.sort(hit))

    def final(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["key", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())][: len(names)], names=names)
        own = Block(table, window)
        kind = replies.column("kind").to_numpy()
        gone = own.removed(marked(own, replies.filter(pa.array(kind == 0))), X.held(replies.filter(pa.array(kind == 1)).column("numbers"), "<u4")[0])
        n_words, n_removed = np.diff(own.starts), W.per_text(gone, own.starts)
        kept = np.concatenate([[0], np.cumsum(n_words - n_removed)])
        left = own.flat.filter(pa.array(~gone))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), left), pa.scalar(" ", pa.large_string()))
        digest = [hashlib.sha256(x).hexdigest() for x in texts.cast(pa.large_binary()).to_pylist()]
        out = [table.column("key"), pa.array(n_words), pa.array(n_removed), pa.array(digest)]
        return pa.table([*out, *([texts.cast(pa.string())] if with_text else [])], names=names)

    sent = dealt.groupBy("block").applyInArrow(anchors, "bucket long, block long, base long, hashes binary")
    reply = sent.groupBy("bucket").applyInArrow(shared, "block long, numbers binary")
    whole = dealt.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(windows, "bucket long, block long, base long, big binary, small binary, least binary")
    second = whole.groupBy("bucket").applyInArrow(later, "block long, numbers binary")
    both = reply.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)))
    schema = "key long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    out = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(final, schema)
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *[c for c in out.columns if c != "key"])

"""Periodic runs of words, found by a dictionary of basic factors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import words as W

# A run is at least this long, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Neighbours compared at once when a proposed run is extended.
_REACH = 64


def _renamed(keys: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors that occur twice in their text: places in order, names, and the way to the next occurrence there (0: none)."""
    order = np.argsort(keys, kind="stable")
    k, p = keys[order], at[order]
    d = doc[p]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    near = np.zeros(len(p), np.int64)
    near[:-1][same] = (p[1:] - p[:-1])[same]
    kept = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    name = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))
    back = np.argsort(p[kept])
    return p[kept][back], name[kept][back], near[kept][back]


def _reached(codes: np.ndarray, at: np.ndarray, period: np.ndarray, border: np.ndarray, step: int) -> np.ndarray:
    """How far words at ``at``, going by ``step``, equal those ``period`` ahead before ``border`` is met."""
    out = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    while len(active):
        offset = step * np.arange(_REACH)
        a = at[active, None] + step * out[active, None] + offset
        inside = a < border[active, None] if step > 0 else a >= border[active, None]
        a = np.where(inside, a, 0)
        equal = inside & (codes[a] == codes[a + period[active, None]])
        length = np.where(equal.all(1), _REACH, np.argmin(equal, 1))
        out[active] += length
        active = active[length == _REACH]
    return out


def find_runs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and smallest period of all runs, in that order, of numbered words ``codes`` of texts that begin at ``starts``.

    Factors of one word are named by their word, those of twice the length by the pair of names of their halves; a factor that
    occurs once in its text is left out, and so is all that holds it. The next occurrence of a factor, if at most twice its length
    away, gives a distance. Where it stays the same over more places than itself, three occurrences and more form an arithmetic
    progression and propose a run of that period. For a run of ``LEAST_PERIODS`` periods that is so at the first length that holds
    a period. Proposals are extended to both sides as far as words a period apart are identical; of those over the same words the
    smallest period stays.
    """
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    last = starts[1:][doc]
    longest = int(sizes.max()) // LEAST_PERIODS if len(sizes) else 0
    empty = np.zeros(0, np.int64)
    found = [(empty, empty, empty)]
    width, at, names = 1, np.arange(len(codes)), codes
    while len(at) and width < 2 * longest:
        at, names, near = _renamed(names, at, doc)
        near[near > 2 * width] = 0
        cut = np.ones(len(at) + 1, bool)
        cut[1:-1] = (at[1:] != at[:-1] + 1) | (near[1:] != near[:-1]) | (doc[at[1:]] != doc[at[:-1]])
        edge = np.nonzero(cut)[0]
        first, count = edge[:-1], np.diff(edge)
        good = (near[first] > 0) & (count > near[first])
        period, begin = near[first[good]], at[first[good]]
        end = begin + count[good] + width - 1
        ahead = _reached(codes, end, period, last[begin] - period, 1)
        behind = _reached(codes, begin - 1, period, starts[:-1][doc[begin]], -1)
        begin, end = begin - behind, end + ahead + period
        long = end - begin >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append((begin[long], end[long], period[long]))
        # Both halves occur twice or the whole does not.
        slot = np.full(len(codes) + width, -1, np.int64)
        slot[at] = names
        both = (slot[at + width] >= 0) & (at + 2 * width <= last[at])
        at = at[both]
        names = names[both] * np.int64(len(codes) + 1) + slot[at + width]
        width *= 2
    begin, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[new], end[new], period[new]
    order = np.lexsort((period, begin))
    begin, end, period = begin[order], end[order], period[order]
    return doc[begin], begin - starts[:-1][doc[begin]], end - begin, period


def _strongest(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Number of each text's run of most periods; ties: smallest start, then period. Exact while length x period is below 2 ** 52."""
    order = np.lexsort((period, start, -(length / period), text))
    new = np.ones(len(order), bool)
    new[1:] = text[order][1:] != text[order][:-1]
    return order[new]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """Runs of every whole text: stretches of ``max(6, 4 * period)`` words or more in which words a period apart are identical.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A stretch is as long as its period allows, and its period is the smallest it has.
    Returns key, n_runs, and start, length, period, exponent_milli (``floor(1000 * length / period)``) of the run of most periods
    (ties: smallest start, then period; null without a run), runs_sha256 of ``start,length,period`` lines, and collapsed_sha256 of the words
    left, joined by one space, when every run keeps its first period only. ``with_runs`` adds the runs, ``with_text`` the text left.

    Every row is taken by itself, so no key, null or repeated, has any effect. Null and empty texts have no words and no runs.
    A task looks at about 4 MB of texts, or one longer text, at a time. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(docs.select(key).dtypes)[key]
    schema = "key {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string".format(kind)
    schema += ", runs array<struct<start:long,length:long,period:long>>" if with_runs else ""
    schema += ", collapsed string" if with_text else ""

    def described(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = W.split_words(W.filled(part.column("text")))
        codes, _ = W.coded(flat)
        owner, start, length, period = find_runs(codes, starts)
        n = part.num_rows
        n_runs = np.bincount(owner, minlength=n)
        best = _strongest(owner, start, length, period)
        some = np.zeros(n, bool)
        some[owner[best]] = True
        pick = np.zeros(n, np.int64)
        pick[owner[best]] = best

        def shown(values: np.ndarray) -> pa.Array:
            return pa.array(values[pick] if len(values) else np.zeros(n, np.int64), pa.int64(), mask=~some)

        lines = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
        edge = np.concatenate([[0], np.cumsum(n_runs)])
        digests = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        depth = np.zeros(len(codes) + 1, np.int64)
        begin = starts[:-1][owner] + start
        np.add.at(depth, begin + period, 1)
        np.add.at(depth, begin + length, -1)
        left = np.cumsum(depth)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(W.per_text(left, starts))])
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), flat.filter(pa.array(left))), pa.scalar(" ", pa.large_string()))
        out = [part.column("key"), pa.array(n_runs, pa.int64()), shown(start), shown(length), shown(period), shown(1000 * length // np.maximum(period, 1)),
               pa.array(digests, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.large_binary()).to_pylist()], pa.string())]
        names = schema_names[:8]
        if with_runs:
            held = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            out.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), held))
            names = [*names, "runs"]
        if with_text:
            out.append(texts.cast(pa.string()))
            names = [*names, "collapsed"]
        return pa.RecordBatch.from_arrays(out, names)

    schema_names = ["key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.steps(batch, "text"):
                yield described(part)

    out = rows.mapInArrow(scan, schema)
    return out.select(F.col("key").alias(key), *out.columns[1:])


def looped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table whose texts partly loop: with ``h = crc32(decimal key)`` and ``g = h // 10``, where ``h % 10 = 0`` word ``i >= a`` becomes word ``a + (i - a) % p``.

    ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)`` for n words. Other texts, and those of a null key, stay as they are. Returns key and text.
    """
    import zlib

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [None if k is None else zlib.crc32(str(k).encode()) for k in batch.column(0).to_pylist()]
            texts = batch.column(1).cast(pa.large_string())
            hit = [i for i, h in enumerate(marks) if h is not None and h % 10 == 0]
            if hit:
                flat, starts = W.split_words(W.filled(texts.take(pa.array(hit))))
                for j, i in enumerate(hit):
                    n, g = int(starts[j + 1] - starts[j]), marks[i] // 10
                    if n:
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        at = np.arange(n)
                        at[a:] = a + (at[a:] - a) % p
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([" ".join(flat.take(pa.array(starts[j] + at)).to_pylist())])], ["key", "text"])
                    else:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), texts.slice(i, 1).cast(pa.string())], ["key", "text"])
            rest = np.setdiff1d(np.arange(batch.num_rows), hit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rest)), batch.column(1).take(pa.array(rest)).cast(pa.string())], ["key", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(scan, f"key {dict(docs.select(key).dtypes)[key]}, text string")
    return out.select(F.col("key").alias(key), F.col("text").alias(text))

"""Quality rules: bands of zstandard ratios over whole texts and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from tabflow.llm import words as W

# Fixed values: (texts of fewer bytes, least ratio, largest ratio); ratio = bytes / compressed bytes at LEVEL.
BANDS = (
    (40, 0.0, 4.0),
    (200, 0.6, 2.3),
    (500, 1.05, 2.2),
    (1000, 1.2, 2.25),
    (2000, 1.35, 2.35),
    (5000, 1.45, 2.5),
    (20000, 1.5, 2.7),
    (1 << 62, 1.55, 3.0),
)
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 2048, 1.3, 3.0, 0.25
LEVEL = 3
MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, n_chunks long, n_bad_chunks long"
)


def repeated_words(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Marks words in windows of ``width`` words that are found twice or more in their text."""
    n, doc = len(codes), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    covered = np.zeros(n, bool)
    at = np.arange(max(0, n - width + 1))
    at = at[doc[at] == doc[at + width - 1]]
    if not len(at):
        return covered
    key = W.spread64(doc[at].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64)
    key = W.spread64(key)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return covered
    near = np.searchsorted(twice, key)
    at = at[(near < len(twice)) & (twice[np.minimum(near, len(twice) - 1)] == key)]
    # Equal hashes are only candidates; ranks of the words themselves decide.
    rank = doc[at]
    for k in range(width):
        rank = np.unique(rank * (codes.max() + 1) + codes[at + k], return_inverse=True)[1].astype(np.int64)
    at = at[np.bincount(rank)[rank] > 1]
    for k in range(width):
        covered[at + k] = True
    return covered


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line of the text."""
    lines = pc.split_pattern(texts, "\n")
    starts = np.asarray(lines.offsets, dtype=np.int64)
    starts = starts - starts[0]
    flat = lines.flatten()
    codes, distinct = W.coded(flat)
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    use = worded[codes]
    doc, codes = doc[use], codes[use]
    first = np.unique(doc * max(1, len(distinct)) + codes) // max(1, len(distinct))
    return np.bincount(doc, minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def _bands(data: np.ndarray, at: np.ndarray, bands, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole ratio, chunks, chunks out of band, and the verdict of each text."""
    packer, view = zstandard.ZstdCompressor(level=LEVEL), memoryview(data)
    n = len(at) - 1
    ratio, chunks, bad, kept = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(n):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi == lo:
            continue
        ratio[i] = (hi - lo) / len(packer.compress(view[lo:hi]))
        if hi - lo >= 2 * chunk:
            for k in range(lo, hi - chunk + 1, chunk):
                part = chunk / len(packer.compress(view[k : k + chunk]))
                chunks[i] += 1
                bad[i] += not CHUNK_LOW <= part <= CHUNK_HIGH
        _, low, high = next(b for b in bands if hi - lo < b[0])
        kept[i] = low <= ratio[i] <= high and bad[i] <= CHUNK_SHARE * chunks[i]
    return ratio, chunks, bad, kept


def compression_bands(docs: DataFrame, key: str = "doc_id", text: str = "text", bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """Counts, ratios and verdict of every whole text.

    A text is kept if its base counts pass, its ratio is inside the band of its length in bytes, and at most
    ``CHUNK_SHARE`` of its full chunks of ``chunk`` bytes (texts of two chunks or more) are outside the chunk band.
    Null and empty texts have no words, ratio 0, and fail. Repeated rows and ids stay as they are; other columns
    are ignored. One text is held whole in its task, nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole, "text"):
                texts = W.filled(batch.column("text"))
                data, at = W.raw_bytes(texts)
                flat, starts = W.split_words(texts)
                codes, _ = W.coded(flat)
                n_words = np.diff(starts)
                symbol = np.zeros(256, bool)
                symbol[list(SYMBOLS)] = True
                repeat = W.per_text(repeated_words(codes, starts, REPEAT_WORDS), starts)
                ratio, chunks, bad, kept = _bands(data, at, bands, chunk)
                failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
                out = [
                    n_words, W.per_text(~W.SPACE[data] & ((data & 0xC0) != 0x80), at), W.per_text(symbol[data], at), duplicate_lines(texts), repeat,
                    failed, kept & ~failed, ratio, chunks, bad,
                ]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, out)], names=[key, *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")

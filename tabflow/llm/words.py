"""Words of whole texts as Arrow arrays, for operators that work on batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that a step looks at together; a longer text is a step of its own.
STEP_BYTES = 4 << 20
# ``[\x20\x09-\x0D]``, what separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have at most ``limit`` bytes, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def filled(texts) -> pa.Array:
    """Texts as one large-string array, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` in order, and where each text's words begin (one more entry at the end)."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    ends = np.asarray(parts.offsets, dtype=np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(keep), before[ends - ends[0]]


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers into a list of the distinct words."""
    found = flat.dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each text begins."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def spread64(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of unsigned 64-bit numbers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same on every machine."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(dictionary))


def rolling(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``width`` neighbours; entry i starts at i. Runs may cross texts, callers mask those."""
    if len(hashes) < width or width <= 0:
        return np.zeros(0, np.uint64)

    def joined(w: int) -> np.ndarray:
        if w == 1:
            return hashes
        half = joined(w // 2)
        n = len(hashes) - w + 1
        if w % 2 == 0:
            return half[:n] * np.uint64(pow(base, w // 2, 1 << 64)) + half[w // 2 : w // 2 + n]
        front = half[: n + 1] * np.uint64(pow(base, w // 2, 1 << 64)) + half[w // 2 : w // 2 + n + 1]
        return front[:n] * np.uint64(base) + hashes[w - 1 :]

    return spread64(joined(int(width)))

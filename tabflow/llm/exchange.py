"""Hashes of blocks of texts, dealt to tasks by their value and answered: packed arrays instead of a row for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def layout(total_bytes: int, block_bytes: int, most_blocks: int = 4096, largest: int = 32 << 20) -> tuple[int, int]:
    """Blocks of texts, and buckets of hashes.

    Blocks grow to ``largest`` bytes of text before there are more than ``most_blocks``. A bucket gets what about eight blocks send, a few
    bytes for every word. Blocks send one row for each bucket they have hashes in, so never more rows than hashes.
    """
    block_bytes = max(block_bytes, min(largest, -(-total_bytes // most_blocks)))
    blocks = max(1, -(-total_bytes // block_bytes))
    return blocks, max(min(blocks, 32), -(-blocks // 8))


def cut(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers in use for ascending hashes, and where each begins."""
    bucket = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0] if len(bucket) else np.zeros(0, np.int64)
    return bucket[at].astype(np.int64), at


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary per range of ``values``; ranges begin at ``at``."""
    ends = (np.concatenate([at, [len(values)]]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def held(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries, and how many each holds."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate([*parts, np.zeros(0, kind)]).astype(kind), np.array([len(p) for p in parts], np.int64)

"""Blocks of a join that a task reads as a stream: the members of a block first, then its visitors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_streams(rows: DataFrame, block: list[str], handle: Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str, visitors_at_once: int = 2048) -> DataFrame:
    """Calls ``handle(members, visitors)`` for every block of ``rows``.

    Members are the rows of ``role`` 0 of a block, and must be few enough for a task's memory. The rows of ``role`` 1 follow in tables of
    ``visitors_at_once`` rows or fewer, however many there are. ``block`` names integer columns. A block without members is passed over.
    """
    dealt = rows.repartition(*block).sortWithinPartitions(*block, "role")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(batches, [*block, "role"])
        ahead = next(pieces, None)
        while ahead is not None:
            name = ahead[0][:-1]
            held = []
            while ahead is not None and ahead[0] == (*name, 0):
                held.append(ahead[1])
                ahead = next(pieces, None)

            def visitors():
                nonlocal ahead
                while ahead is not None and ahead[0] == (*name, 1):
                    part = ahead[1]
                    for i in range(0, part.num_rows, visitors_at_once):
                        yield pa.Table.from_batches([part.slice(i, visitors_at_once)])
                    ahead = next(pieces, None)

            if held:
                yield from handle(pa.Table.from_batches(held), visitors())
            for _ in visitors():
                pass

    return dealt.mapInArrow(scan, schema)


def _pieces(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal values in ``names``, with these values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
        edge = np.concatenate([[0], np.nonzero((values[1:] != values[:-1]).any(axis=1))[0] + 1, [len(values)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield tuple(values[a].tolist()), batch.slice(a, b - a)


def vectors(column: pa.Array | pa.ChunkedArray, kind: str = "<f8") -> np.ndarray:
    """Binaries of one length as the rows of a matrix."""
    parts = column.to_pylist()
    if not parts:
        return np.zeros((0, 0), kind)
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)

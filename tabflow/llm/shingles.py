"""Sets of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tabflow.llm import words as W


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Distinct hashes of the runs of ``width`` words of each text, ascending.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    flat, starts = W.split_words(texts)
    codes, distinct = W.coded(flat)
    hashes = W.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    runs = W.rolling(hashes, width)
    out = []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        if hi - lo >= width:
            out.append(np.unique(runs[lo : hi - width + 1]))
        else:
            out.append(W.rolling(hashes[lo:hi], hi - lo)[:1] if hi > lo else np.zeros(0, np.uint64))
    return out

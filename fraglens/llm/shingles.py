"""Sets of word shingles as sorted 64-bit fingerprints, shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np

from . import text as T


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle fingerprints of one document after the other, bounds of the documents)."""
    buf, starts = T.separated(raw, off)
    buf = T.LOWER[buf]
    w = T.Words(buf, starts, T.WHITE)
    h = T.word_hashes(buf, w)
    full = np.flatnonzero(T.within(w, size))
    values, docs = [T.window_hashes(h, size)[full]], [w.doc[full]]
    with np.errstate(over="ignore"):
        for n in range(1, size):
            short = np.flatnonzero(w.count == n)
            acc = np.zeros(len(short), np.uint64)
            for k in range(n):
                acc = acc * np.uint64(T.WORD_BASE) + h[w.first[short] + k]
            values.append(T.mix(acc))
            docs.append(short)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(off)))


def set_ids(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(value ^ np.uint64(T.BYTE_BASE)), dtype=np.uint64)))
        return T.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)

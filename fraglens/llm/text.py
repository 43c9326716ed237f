"""Vectorised byte-level text primitives shared by the operators.

All functions work on one flat ``uint8`` buffer that holds many documents, each
followed by a separator byte, so that no Python loop runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20
MASK64 = (1 << 64) - 1
_rng = np.random.RandomState(20240229)
#: A random odd multiplier for each kind of rolling fingerprint, and a random 64-bit value for each byte.
BYTE_BASE = int(_rng.randint(1, 2**62)) * 2 + 1
WORD_BASE = int(_rng.randint(1, 2**62)) * 2 + 1
BYTE_VALUE = _rng.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """A 256-entry table, true for bytes within the inclusive spans."""
    table = np.zeros(256, bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


#: Words are runs of anything but white space.
WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII digits, ASCII lower-case letters after folding, and all bytes of non-ASCII characters.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, null flags) of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    nulls = np.asarray(column.is_null())
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()).fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], nulls


def separated(raw: np.ndarray, off: np.ndarray, gap: int = 1, fill: int = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Each document followed by ``gap`` bytes ``fill``; returns the buffer and the document starts (with the end)."""
    n = len(off) - 1
    out = np.full(len(raw) + gap * n, fill, np.uint8)
    starts = off + gap * np.arange(n + 1)
    if n:
        keep = np.ones(len(out), bool)
        for g in range(gap):
            keep[starts[1:] - 1 - g] = False
        out[keep] = raw
    return out, starts


class Words:
    """Word bounds in a separated buffer: start, end (exclusive), document index."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, gaps: np.ndarray):
        inside = ~gaps[buf]
        edge = np.diff(np.concatenate((np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8))))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.n_docs = len(starts) - 1
        #: The first word of each document, and the number of words at the end.
        self.first = np.searchsorted(self.start, starts)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def __len__(self) -> int:
        return len(self.start)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and its inverse mod 2**64 for j < n."""
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        up[:1] = 1
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        down[:1] = 1
        return np.multiply.accumulate(up, dtype=np.uint64), np.multiply.accumulate(down, dtype=np.uint64)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _cache or len(_cache[base][0]) < n:
        _cache[base] = _powers(base, max(n, 1 << 16))
    return _cache[base][0][:n], _cache[base][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which all bits depend on all others."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, w: Words, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes, a slice of the buffer at a time."""
    out = np.empty(len(w), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(w):
            lo = w.start[at]
            to = max(at + 1, int(np.searchsorted(w.end, lo + step, "right")))
            hi = w.end[to - 1]
            up, down = powers(BYTE_BASE, int(hi - lo))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[buf[lo:hi]] * up, dtype=np.uint64)))
            s, e = w.start[at:to] - lo, w.end[at:to] - lo
            out[at:to] = mix((sums[e] - sums[s]) * down[s])
            at = to
    return out


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of h[i : i + n] for each i, whatever documents they cross."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # Horner's rule over the n words of all windows at once: no products of far powers are needed.
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(WORD_BASE) + h[k : len(h) - n + 1 + k]
        return mix(acc)


def within(w: Words, n: int) -> np.ndarray:
    """Whether the n words from each word on, without the last n - 1, lie in one document."""
    return w.doc[: max(0, len(w) - n + 1)] == w.doc[n - 1 :] if len(w) >= n else np.zeros(0, bool)


def covered(n_words: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n_words words lie in [p, p + size) for some p in ``at``."""
    delta = np.zeros(n_words + 1, np.int32)
    np.add.at(delta, at, 1)
    np.add.at(delta, np.minimum(at + size, n_words), -1)
    return np.cumsum(delta[:-1]) > 0


def to_strings(buf: np.ndarray, off: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """UTF-8 strings of the buffer between the offsets, without copies of single strings."""
    mask = None
    if nulls is not None and nulls.any():
        mask = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [mask, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(buf.tobytes())])


def slices(batch: pa.RecordBatch, column: str, most: int) -> list[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` text bytes; one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        out.append(batch.slice(at, to - at))
        at = to
    return out

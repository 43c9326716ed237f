"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each a word of
the perfect Golay code [23, 12, 7] with zeros in front. Every word has one
nearest codeword, at distance 3 at most, and one or six codewords within
distance 4. Hence two words that differ in
* at most 2 bits have a codeword within distance 4 in common, and
* at most 1 bit: the one's nearest codeword is within distance 4 of the other.
Four errors fall on three segments so that either some segment has none and
another at most 2, or all have one at least, and then two have just one. So the
keys are, for each ordered pair of segments, one segment as it is with each of
the other's near codewords (33 bits), and for each pair, both nearest codewords
when stored, all pairs of near codewords when probing (24 bits). No link within
four bits is missed.

Equal fingerprints are one row before any key is made, so exact copies cost
nothing. A bucket never lists pairs: it compares all with all, and sends one link
from each fingerprint to the smallest of its component in the bucket. Buckets come
out of a sort one after another, so that a task holds one of at most ``SMALL``
fingerprints at a time. The fingerprints of larger ones are keyed again, finer: 4 of
8 segments that must be without error (32 bits), then 8 of 12 (42 bits), and at last
all points within two bits, one of which two words within four bits share, and each
of which no more than 2,081 words are near. So a hot bucket is dealt out over many
tasks, and no link is lost. The links' components are found in Spark tables.

Special cases: null and empty texts have fingerprint zero and link like others;
fewer words than a shingle are one shingle; texts of any length are read whole; a
bit that is set in just half the shingles is 0; a null id takes part with its
fingerprint, and its own smallest id counts only where no other is there; repeated
rows get a row each; an empty table gives an empty result; extra columns, whatever
their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T
from .components import connected_components

RADIUS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SLICE_BYTES = 2 << 20
#: Buckets up to this size compare all with all, larger ones are keyed finer: so many segments, of which so many are without error.
SMALL = 4096
FINER = ((8, 4), (12, 8))
GENERATOR = 0b101011100011  # of the cyclic Golay code


# -- fingerprints -----------------------------------------------------------


def fingerprints(raw: np.ndarray, off: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each document: a bit is 1 if set in over half the shingles' XXH64."""
    buf, starts = T.separated(raw, off)
    buf = T.LOWER[buf]
    inside = ~T.WHITE[buf]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one separator after each word
    count = np.concatenate(([0], np.cumsum(keep)))
    flat = np.where(inside, buf, T.SPACE).astype(np.uint8)[keep]
    w = T.Words(flat, count[starts], T.WHITE)
    per_doc = np.where(w.count >= shingle, w.count - shingle + 1, np.minimum(w.count, 1))
    full = np.flatnonzero(T.within(w, shingle))
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    first = np.concatenate((full, w.first[short]))
    last = np.concatenate((full + shingle - 1, w.first[short] + w.count[short] - 1))
    order = np.argsort(first, kind="stable")
    view, digest = flat.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(off) - 1, np.uint64)
    s, e = w.start[first[order]], w.end[last[order]]
    bounds = np.concatenate(([0], np.cumsum(per_doc)))
    sums = np.zeros((len(off) - 1, 64), np.int64)
    step = 1 << 15
    for at in range(0, len(s), step):
        h = np.array([digest(view[a:b], seed) for a, b in zip(s[at : at + step].tolist(), e[at : at + step].tolist(), strict=True)], np.uint64)
        bit = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = int(np.searchsorted(bounds, at, "right")) - 1
        hi = int(np.searchsorted(bounds, at + len(h), "left"))
        cuts = np.clip(bounds[lo:hi] - at, 0, len(h))
        live = np.flatnonzero(np.diff(np.append(cuts, len(h))))
        sums[lo + live] += np.add.reduceat(bit, cuts[live], axis=0, dtype=np.int32)
    packed = np.packbits(2 * sums > per_doc[:, None], axis=1, bitorder="little")
    out[:] = packed.reshape(-1).view(np.uint64) if len(packed) else 0
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp)"""

    @B.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE_BYTES):
                raw, off, _ = T.buffers(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(raw, off, shingle).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


# -- Golay code -------------------------------------------------------------


def _remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the generator polynomial over GF(2): zero for codewords."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the error of least weight, and what to add to a word for each of its near codewords (-1: none)."""
    error = np.zeros(2048, np.uint32)
    for w in range(4):
        flips = _masks(23, w).astype(np.uint32)
        error[_remainder(flips)] = flips
    add = np.full((2048, 6), -1, np.int32)
    add[:, 0] = error
    filled = np.ones(2048, np.int8)
    for f in _masks(23, 4).astype(np.uint32).tolist():
        r = int(_remainder(np.array([f], np.uint32))[0])
        add[r, filled[r]] = f
        filled[r] += 1
    return error, add


def near_codewords(x: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the numbers of the codewords within distance 4: the nearest first, -1 for none.

    Any 12 neighbouring bits of a cyclic code's word tell it from all others; the upper ones are its number.
    """
    x = x.astype(np.uint32)
    add = _tables()[1][_remainder(x)]
    return np.where(add < 0, -1, (x[:, None] ^ add.astype(np.uint32)).astype(np.int32) >> 11).astype(np.int16)


def _masks(bits: int, weight: int) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    top = np.full(1, -1)
    for _ in range(weight):
        parts = [(out[top < b] | np.uint64(1 << b), b) for b in range(bits)]
        out = np.concatenate([p for p, _ in parts])
        top = np.concatenate([np.full(len(p), b) for p, b in parts])
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index into fp, role) of the fingerprints: role 0 stored, 1 probing, 2 both."""
    seg = [(fp >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    near = [near_codewords(s) for s in seg]
    row = np.arange(len(fp))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                got = near[j] >= 0
                out.append(((np.uint64(tag) << np.uint64(40) | seg[i][:, None] << np.uint64(12) | near[j].astype(np.uint64) & np.uint64(4095))[got], np.nonzero(got)[0], 2))
                tag += 1
    for i in range(3):
        for j in range(i + 1, 3):
            head = np.uint64(tag) << np.uint64(40)
            out.append((head | near[i][:, 0].astype(np.uint64) << np.uint64(12) | near[j][:, 0].astype(np.uint64), row, 0))
            for a in range(6):
                for b in range(6):
                    if a or b:
                        got = (near[i][:, a] >= 0) & (near[j][:, b] >= 0)
                        out.append(((head | (near[i][:, a].astype(np.uint64) & np.uint64(4095)) << np.uint64(12) | near[j][:, b].astype(np.uint64) & np.uint64(4095))[got], row[got], 1))
            tag += 1
    return np.concatenate([k for k, _, _ in out]), np.concatenate([r for _, r, _ in out]), np.concatenate([np.full(len(k), role, np.int8) for k, _, role in out])


def finer_keys(fp: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into fp): two words within RADIUS bits have a key in common; past the last level, that is a point within two bits of both."""
    if level >= len(FINER):
        points = fp[:, None] ^ np.concatenate([_masks(64, w) for w in range(RADIUS // 2 + 1)])
        return points.reshape(-1), np.repeat(np.arange(len(fp)), points.shape[1])
    n, same = FINER[level]
    cuts = [64 * i // n for i in range(n + 1)]
    out = []
    for tag, chosen in enumerate(combinations(range(n), same)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
        out.append(T.mix((fp & np.uint64(mask)) ^ T.mix(np.array([tag + 1], np.uint64))))
    return np.concatenate(out), np.tile(np.arange(len(fp)), len(out))


# -- buckets ----------------------------------------------------------------


def bucket_links(fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For sorted distinct fingerprints, the number of the smallest one that each is linked to, directly or not."""
    root = np.arange(len(fp))
    for i in range(len(fp) - 1):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1
        far = near[root[near] != root[i]]
        if len(far):
            joined = np.unique(np.append(root[far], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


class _Links:
    """Links (fingerprint, smallest of its component in the bucket) of sorted buckets; of buckets that are too large, the fingerprints."""

    def __init__(self, most: int | None):
        self.most, self.hot_key = most, None
        self.held: tuple[np.ndarray, ...] | None = None

    def take(self, key: np.ndarray, fp: np.ndarray, role: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, hot) of all buckets that are over."""
        if self.held is not None:
            key, fp, role = (np.concatenate(x) for x in zip(self.held, (key, fp, role), strict=True))
        end = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1], "left"))
        hot = [fp[:0]]
        if self.most is not None and self.hot_key is not None and len(key):
            more = int(np.searchsorted(key, np.uint64(self.hot_key), "right"))
            hot.append(fp[:more])
            key, fp, role, end = key[more:], fp[more:], role[more:], max(end - more, 0)
            if len(key):
                self.hot_key = None
        a, b, large = self._links(key[:end], fp[:end], role[:end])
        hot.append(large)
        key, fp, role = key[end:], fp[end:], role[end:]
        if self.most is not None and len(key) > 4 * self.most:
            # The bucket goes on; a fingerprint may be in it up to three times.
            self.hot_key = int(key[0])
            hot.append(fp)
            key, fp, role = key[:0], fp[:0], role[:0]
        self.held = key, fp, role
        return a, b, np.unique(np.concatenate(hot))

    def _links(self, key: np.ndarray, fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(key):
            return fp, fp, fp
        head = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        size = np.diff(np.append(head, len(key)))
        # A bucket of probes alone has nothing stored; its fingerprints meet elsewhere if they are near.
        stored = np.maximum.reduceat(role != 1, head)
        two = head[(size == 2) & stored]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        a, b, hot = [fp[near]], [fp[near + 1]], [fp[:0]]
        for h, n in zip(head[(size > 2) & stored].tolist(), size[(size > 2) & stored].tolist(), strict=True):
            x = np.unique(fp[h : h + n])
            if self.most is not None and len(x) > self.most:
                hot.append(x)
            elif len(x) > 1:
                root = bucket_links(x)
                moved = root != np.arange(len(x))
                a.append(x[root[moved]])
                b.append(x[moved])
        return np.concatenate(a), np.concatenate(b), np.concatenate(hot)


def _level(fps: DataFrame, n: int, level: int) -> DataFrame:
    """(a, b): links of one level of keys, -1 the Golay code's; b is null for a fingerprint of a bucket that is too large."""

    @B.lean
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            step = 4096 if level < 0 else 512
            for at in range(0, len(fp), step):
                part = fp[at : at + step]
                key, row, *role = keys(part) if level < 0 else finer_keys(part, level)
                role = role[0] if role else np.full(len(key), 2, np.int8)
                yield pa.RecordBatch.from_arrays([pa.array((key ^ np.uint64(1 << 63)).view(np.int64)), pa.array(part[row].view(np.int64)), pa.array(role)], names=["key", "fp", "role"])

    @B.lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links(SMALL if level < len(FINER) else None)
        none = np.zeros(0, np.uint64)
        for part in chain(((np.asarray(x.column("key")).view(np.uint64) ^ np.uint64(1 << 63), np.asarray(x.column("fp")).view(np.uint64), np.asarray(x.column("role"))) for x in batches), [None]):
            a, b, hot = links.take(none, none, np.zeros(0, np.int8), True) if part is None else links.take(*part)
            pairs = np.unique(np.stack((a, b)), axis=1)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])
            if len(hot):
                yield pa.RecordBatch.from_arrays([pa.array(hot.view(np.int64)), pa.nulls(len(hot), pa.int64())], names=["a", "b"])

    # Keys are rows of 17 bytes, 1 million in a task.
    each = 150 if level < 0 else 2081 if level >= len(FINER) else comb(*FINER[level])
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * each // 1_000_000 + 1)
    spread = fps.repartition(max(1, min(parts, n // 1000 + 1)))
    return spread.mapInArrow(expand, "key bigint, fp bigint, role tinyint").repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(verify, "a bigint, b bigint")


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all within RADIUS bits into the same components."""
    out, level = None, -1
    while True:
        got = B.cut(_level(fps, fps.count(), level))
        links = got.filter("b is not null")
        out = links if out is None else out.unionByName(links)
        if not got.filter("b is null").limit(1).count():
            return out
        fps, level = B.cut(got.filter("b is null").select(F.col("a").alias("fp")).distinct()), level + 1


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): all documents, with the smallest id reachable over links of RADIUS bits or fewer."""
    table = B.cut(fingerprint_table(docs, id_col, text_col, shingle))
    distinct = B.cut(table.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = connected_components(near_links(distinct.select("fp")))
    member = member.select(F.col("node").alias("fp"), "root")
    own = distinct.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    label = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(label, "root").select("fp", "component_id")
    return table.join(named, "fp", "left").select("doc_id", "fp", "component_id")

"""Exact substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``anchor`` words
(with windows of ``window`` words, anchor = (window + 1) // 2, so that any window
contains a whole block). The blocks' fingerprints form the index, which is dealt
out over hash buckets; every rolling run of ``anchor`` words of every document
probes it. A hit whose run occurs in at least two documents is an anchor shared
by documents. It is extended to both sides as far as ``window`` words reach, and
the windows around it meet in a second exchange, which tells for each whether its
word sequence also starts in a document with a smaller id. Windows that do so and
overlap make up one maximal repeat; these are removed (``spans``), and the first
document keeps its copy. Comparing windows by what they contain, and not hits by
pairs, keeps a passage that thousands of documents share to one entry per block of
documents and bucket: no pairs are ever listed and no key is hot.

Word sequences are compared by fingerprints: 48 bits for probes, where a clash
only adds a candidate, and two independent ones of 64 and 32 bits for windows, so
that among 10**13 different windows a false match is expected with probability
10**-3 in all. The words of windows have fingerprints of 64 bits.

Results in special cases: null and empty texts have no words and stay as they
are; rows with a null id neither lose words nor serve as an earlier document;
rows with equal ids are one document for "smaller" (none is smaller than the
other), so that repeated rows lose the same words; documents with under ``window``
words keep all; texts of any length are one document of one block; an empty table
gives an empty result. Extra columns, whatever their names, are kept if named in
``carry``. Memory: some times the largest of a block (4 MB of text) and the longest
single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import blocks as B
from . import text as T

WINDOW = 13


def _probes(block: B.Block, anchor: int) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, word fingerprints, positions of probes, their sorted distinct keys, key number of each probe, ok flag by word."""
    w = T.Words(block.buf, block.starts, T.WHITE)
    h = T.word_hashes(block.buf, w)
    inside = T.within(w, anchor)
    inside &= ~block.id_nulls[w.doc[: len(inside)]]
    at = np.flatnonzero(inside)
    keys = T.window_hashes(h, anchor)[at] & np.uint64(0xFFFFFFFFFFFF0000)
    distinct, number = np.unique(keys, return_inverse=True)
    return w, h, at, distinct, number, inside


def _requests(block: B.Block, window: int, n: int):
    anchor = (window + 1) // 2
    w, _, at, distinct, number, _ = _probes(block, anchor)
    if not len(at):
        return
    aligned = np.zeros(len(distinct), bool)
    aligned[number[(at - w.first[w.doc[at]]) % anchor == 0]] = True
    lo = np.full(len(distinct), np.iinfo(np.int64).max)
    hi = np.full(len(distinct), np.iinfo(np.int64).min)
    ids = block.id[w.doc[at]]
    np.minimum.at(lo, number, ids)
    np.maximum.at(hi, number, ids)
    many = lo < hi
    for bucket, s in B.split_sorted(distinct, n):
        # One document here: its id tells whether other blocks' rows of the same id are the same document.
        yield {"bucket": bucket, "block_id": block.block_id, "n": s.stop - s.start, "keys": B.squeeze_sorted(distinct[s] >> np.uint64(16)), "flags": B.bits(np.concatenate((aligned[s], many[s]))), "ids": B.squeeze(lo[s])}


def _shared(got: dict[str, list]):
    """For each request, which of its keys are blocks of some document and runs of at least two."""
    sizes = np.array(got["n"])
    keys = np.concatenate([B.expand_sorted(x) for x in got["keys"]])
    flags = [B.unbits(x, 2 * n) for x, n in zip(got["flags"], sizes, strict=True)]
    aligned = np.concatenate([f[:n] for f, n in zip(flags, sizes, strict=True)])
    many = np.concatenate([f[n:] for f, n in zip(flags, sizes, strict=True)])
    ids = np.concatenate([B.expand(x, np.int64) for x in got["ids"]])
    order = np.argsort(keys)
    head = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] ^ np.uint64(1)))
    ids = ids[order]
    good = np.logical_or.reduceat(aligned[order], head) & (np.logical_or.reduceat(many[order], head) | (np.minimum.reduceat(ids, head) < np.maximum.reduceat(ids, head)))
    back = np.empty(len(keys), bool)
    back[order] = np.repeat(good, np.diff(np.append(head, len(keys))))
    at = 0
    for block_id, n, bucket in zip(got["block_id"], sizes.tolist(), got["bucket"], strict=True):
        if back[at : at + n].any():
            yield {"block_id": block_id, "phase": 1, "bucket": bucket, "n": n, "hits": B.bits(back[at : at + n])}
        at += n


def _hit_keys(distinct: np.ndarray, answers: list[dict], n: int) -> np.ndarray:
    told = {x["bucket"]: x for x in answers}
    hit = np.zeros(len(distinct), bool)
    if told:
        for bucket, s in B.split_sorted(distinct, n):
            if bucket in told:
                hit[s] = B.unbits(told[bucket]["hits"], told[bucket]["n"])
    return hit


def _pairs(key: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct key, its extra, number of each entry) of pairs, sorted by both."""
    order = np.lexsort((extra, key))
    k, e = key[order], extra[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return k[new], e[new], number


def _candidates(block: B.Block, answers: list[dict], window: int, n: int):
    """Windows around shared anchors: positions, fingerprints sorted and distinct, number of each, least id of each."""
    anchor = (window + 1) // 2
    w, h, at, distinct, number, _ = _probes(block, anchor)
    hit = _hit_keys(distinct, [x for x in answers if x["phase"] == 1], n)
    marked = np.zeros(len(w) + 1, np.int64)
    marked[at[hit[number]] + 1] = 1
    marked = np.cumsum(marked)
    fits = np.flatnonzero(T.within(w, window))
    # The window from i on holds the anchors from i to i + window - anchor.
    fits = fits[(marked[fits + window - anchor + 1] > marked[fits]) & ~block.id_nulls[w.doc[fits]]]
    keys = T.window_hashes(h, window)[fits] if len(fits) else np.zeros(0, np.uint64)
    again = T.window_hashes(T.mix(h ^ np.uint64(T.BYTE_BASE)), window)[fits] if len(fits) else keys
    distinct, extra, number = _pairs(keys, (again >> np.uint64(32)).astype(np.uint32))
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, number, block.id[w.doc[fits]])
    return w, fits, distinct, extra, number, least


_WINDOWS = "bucket int, block_id long, n int, keys binary, extra binary, ids binary"
_ANSWERS = "block_id long, phase int, bucket int, n int, hits binary"


def _earlier(got: dict[str, list]):
    """For each request, which of its windows start in a document before all of the request's own."""
    sizes = np.array(got["n"])
    ids = np.concatenate([B.expand(x, np.int64) for x in got["ids"]])
    distinct, _, number = _pairs(np.concatenate([B.expand_sorted(x) for x in got["keys"]]), np.concatenate([B.expand(x, np.uint32) for x in got["extra"]]))
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, number, ids)
    less = first[number] < ids
    at = 0
    for block_id, n, bucket in zip(got["block_id"], sizes.tolist(), got["bucket"], strict=True):
        if less[at : at + n].any():
            yield {"block_id": block_id, "phase": 2, "bucket": bucket, "n": n, "hits": B.bits(less[at : at + n])}
        at += n


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, layout: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text) and the columns ``carry``: the document without its repeats.

    ``spans`` has the removed word spans as pairs first, end (exclusive). With ``layout`` the text keeps its own white
    space and unchanged texts are returned as they are, null included; without it, kept words are joined by one space.
    """
    blocks = B.pack(docs, id_col, text_col, carry)
    n = B.n_buckets(blocks)
    probes = B.from_blocks(blocks, lambda b: _requests(b, window, n), "bucket int, block_id long, n int, keys binary, flags binary, ids binary")
    anchors = B.cut(B.by_bucket(probes, _shared, _ANSWERS))

    def extend(block: B.Block, answers: list[dict]) -> pa.Table:
        _, _, distinct, extra, _, least = _candidates(block, answers, window, n)
        rows = [{"bucket": b, "block_id": block.block_id, "n": s.stop - s.start, "keys": B.squeeze_sorted(distinct[s]), "extra": B.squeeze(extra[s]), "ids": B.squeeze(least[s])} for b, s in B.split_sorted(distinct, n)]
        return pa.Table.from_pylist(rows, B.arrow_schema(_WINDOWS))

    windows = B.with_answers(blocks, anchors, extend, _WINDOWS)
    answers = anchors.unionByName(B.by_bucket(windows, _earlier, _ANSWERS))
    schema = StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, spans array<bigint>, text string")
    for i, c in enumerate(carry):
        schema.add(f"c{i}", docs.schema[c].dataType)

    def cut_out(block: B.Block, answers: list[dict]) -> pa.Table:
        w, at, distinct, _, number, least = _candidates(block, answers, window, n)
        hit = _hit_keys(distinct, [x for x in answers if x["phase"] == 2], n)
        again = hit[number] | (least[number] < block.id[w.doc[at]])
        gone = T.covered(len(w), at[again], window)
        counts = np.bincount(w.doc[gone], minlength=len(block))
        # Runs of removed words, split at document ends.
        first = np.zeros(len(w) + 1, bool)
        first[w.first] = True
        padded = np.concatenate(([False], gone, [False]))
        starts = np.flatnonzero(gone & (first[:-1] | ~padded[:-2]))
        ends = np.flatnonzero(gone & (first[1:] | ~padded[2:])) + 1
        base = w.first[w.doc[starts]] if len(starts) else starts
        spans = np.stack((starts - base, ends - base), 1).reshape(-1)
        at_doc = 2 * np.searchsorted(starts, w.first)
        spans = pa.ListArray.from_arrays(pa.array(at_doc, pa.int32()), pa.array(spans, pa.int64()))
        if layout:
            # A removed word goes with what separates it from the next one.
            till = np.append(w.start[1:], len(block.buf))
            if len(w):
                till = np.minimum(till, block.starts[w.doc + 1] - 1)
            drop = np.zeros(len(block.buf) + 1, np.int8)
            np.add.at(drop, w.start[gone], 1)
            np.add.at(drop, till[gone], -1)
            keep = np.cumsum(drop[:-1], dtype=np.int8) == 0
            del drop
            if len(block):
                keep[block.starts[1:] - 1] = False
            nulls = block.nulls
        else:
            keep = ~T.WHITE[block.buf]
            keep[w.end] = True  # the separator after each word
            size = w.end - w.start + 1
            inside = np.flatnonzero(keep)
            keep[inside[np.repeat(gone, size)]] = False
            last = np.flatnonzero(~gone)
            last = last[np.append(w.doc[last][1:] != w.doc[last][:-1], True)] if len(last) else last
            keep[w.end[last]] = False
            nulls = np.zeros(len(block), bool)
        count = np.zeros(len(block.starts), np.int64)
        some = np.flatnonzero(np.diff(block.starts))
        count[some + 1] = np.add.reduceat(keep, block.starts[some], dtype=np.int64) if len(some) else 0
        count = np.cumsum(count)
        chars = block.buf[keep]
        if not layout:
            chars = np.where(T.WHITE[chars], T.SPACE, chars).astype(np.uint8)
        texts = T.to_strings(chars, count, nulls).cast(pa.string())
        own = [pa.array(block.ids, pa.int64()), pa.array(w.count, pa.int64()), pa.array(counts, pa.int64()), spans, texts]
        return pa.Table.from_arrays([*own, *(block.carried.columns if carry else ())], names=schema.names)

    got = B.with_answers(blocks, answers, cut_out, schema)
    return got.select(*schema.names[:5], *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])

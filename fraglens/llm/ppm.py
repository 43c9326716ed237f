"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to order 4 over the whole alphabet: 255
bytes of UTF-8 text and "end of text". Every context of every training document
is kept with its exact counts, so the model grows with the text. It is spread
over hash buckets by the three bytes before a symbol: blocks of documents send
the counts of their distinct 5-byte codes, and get back the log probability of
each. Orders 0 to 2 are complete too; their cells are bounded by the alphabet
(256**3), so they are summed first and broadcast. Unseen symbols are coded by
escapes (method C: as many as there are distinct symbols) with exclusion: an order
below counts only symbols that the order above has not seen. A text's score is
log10 of the probability of all its bytes and its end; with nothing to learn from,
symbols are uniform.

The unigram base counts words, A-Z lower-cased, exactly: blocks of documents ask hash buckets for
the training counts of their distinct words (see blocks.py), so a frequent word
is one entry for each block. Words are told apart by 64-bit fingerprints.

Special cases: null text counts as empty, which has one token, the end; texts of
any length are learned and scored whole; a null id is held out; repeated rows are
learned and scored each; an empty table gives an empty result; extra columns,
whatever their names, are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T

ORDER = 4
BYTES = 256
FILL = 0xFF  # in no UTF-8 text; around texts, and as a symbol the end
GAPS = T.WHITE | (np.arange(256) == FILL)


def in_fold(doc_id: int | None, modulus: int, rest: int) -> bool:
    """Whether crc32 of the id as text leaves ``rest``; a null id does."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus == rest


def _codes(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5-byte code of each position, its place in the buffer); documents are ORDER fill bytes apart."""
    s = np.concatenate((np.full(ORDER, FILL, np.uint8), buf))
    real = buf != FILL
    real[starts[1:] - ORDER] = True
    at = np.flatnonzero(real)
    code = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | s[at + k]
    return code, at


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct codes, positions by code, where each code's positions begin)."""
    if len(code) <= 1 << 24:
        # Code and position in one number: sorting numbers is much faster than sorting positions.
        packed = np.sort(code << np.uint64(24) | np.arange(len(code), dtype=np.uint64))
        order, code = (packed & np.uint64((1 << 24) - 1)).astype(np.int64), packed >> np.uint64(24)
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    head = np.flatnonzero(np.diff(code, prepend=~code[:1]))
    return code[head], order, head


def _by_context(code: np.ndarray, n: int):
    """(bucket, indices) of sorted codes: all that share the three bytes before the last meet."""
    context = (code >> np.uint64(8)) & np.uint64(BYTES**3 - 1)
    bucket = (T.mix(context + np.uint64(1)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=~bucket[:1])), len(code))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[lo]), order[lo:hi]


def _step(count: np.ndarray, rest: np.ndarray, kinds: np.ndarray, whole: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probability at an order where ``kinds`` symbols with ``rest`` occurrences are not excluded; if it has seen the whole alphabet there is nothing to escape to."""
    size = np.maximum(np.where(whole, rest, rest + kinds), 1)
    return np.where(count > 0, count / size, np.where(kinds > 0, kinds / size, 1.0) * below)


class Low:
    """Orders 0 to 2, from the counts of all sorted 3-byte codes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes.astype(np.int64), counts.astype(np.float64)
        c2, c1s = self.codes >> 8, self.codes & 0xFFFF
        self.total2 = np.bincount(c2, self.counts, BYTES**2)
        self.kinds2 = np.bincount(c2, minlength=BYTES**2)
        self.n1 = np.bincount(c1s, self.counts, BYTES**2)
        n1 = self.n1.reshape(BYTES, BYTES)
        n0 = n1.sum(0)
        self.kinds1 = (n1 > 0).sum(1)
        self.rest1 = n1.sum(1)[np.arange(BYTES**2) & 0xFF] - np.bincount(c2, self.n1[c1s], BYTES**2)
        kinds0 = int((n0 > 0).sum())
        rest0 = n0.sum() - ((n1 > 0) * n0).sum(1)
        blank = np.full((BYTES, BYTES), 1.0 / max(BYTES - kinds0, 1))
        self.escaped1 = _step(np.broadcast_to(n0, blank.shape), rest0[:, None], (kinds0 - self.kinds1)[:, None], np.array(kinds0 == BYTES), blank).reshape(-1)

    def count2(self, code: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.counts[at], 0.0)

    def escaped2(self, code: np.ndarray) -> np.ndarray:
        """Probability of each 3-byte code's symbol after an escape from its two-byte context."""
        c2, c1s = code >> 8, code & 0xFFFF
        c1 = c2 & 0xFF
        return _step(self.n1[c1s], self.rest1[c2], self.kinds1[c1] - self.kinds2[c2], self.kinds1[c1] == BYTES, self.escaped1[c1s])


def log_probabilities(codes: np.ndarray, counts: np.ndarray, low: Low) -> np.ndarray:
    """log10 of each code's symbol after its context. The sorted codes are all those seen with their three-byte contexts, and may be others with count 0."""
    codes = codes.astype(np.int64)
    n4 = counts.astype(np.float64)
    _, g4 = np.unique(codes >> 8, return_inverse=True)
    total4, kinds4 = np.bincount(g4, n4), np.bincount(g4, n4 > 0)
    three, of = np.unique(codes & (BYTES**4 - 1), return_inverse=True)
    n3 = np.bincount(of, n4)
    context3, g3 = np.unique(three >> 8, return_inverse=True)
    total3, kinds3 = np.bincount(g3, n3), np.bincount(g3, n3 > 0)
    c2, code2 = context3 & (BYTES**2 - 1), three & (BYTES**3 - 1)
    n2 = low.count2(code2)
    rest2 = low.total2[c2] - np.bincount(g3, n2 * (n3 > 0))
    e3 = _step(n2, rest2[g3], (low.kinds2[c2] - kinds3)[g3], (low.kinds2[c2] == BYTES)[g3], low.escaped2(code2))
    mine = g3[of]
    rest3 = total3[mine] - np.bincount(g4, n3[of] * (n4 > 0))[g4]
    e4 = _step(n3[of], rest3, kinds3[mine] - kinds4[g4], kinds3[mine] == BYTES, e3[of])
    return np.log10(_step(n4, total4[g4], kinds4[g4], kinds4[g4] == BYTES, e4)).astype(np.float32)


_held: dict[int, Low] = {}


def _low(parts: tuple[bytes, bytes]) -> Low:
    """The worker's tables, built once from the broadcast counts."""
    key = hash(parts)
    if key not in _held:
        _held.clear()
        _held[key] = Low(B.expand(parts[0], np.uint32), B.expand(parts[1], np.int64))
    return _held[key]


_REQUEST = "kind int, bucket int, block_id long, n int, keys binary, counts binary"
_CELLS = "bucket int, keys binary, counts binary"
_ANSWER = "kind int, block_id long, bucket int, n long, counts binary, total long"


def _requests(block: B.Block, n: int, modulus: int, rest: int):
    learned = np.array([not in_fold(x, modulus, rest) for x in block.ids], bool)
    w = T.Words(block.buf, block.starts, GAPS)
    keys, number = np.unique(T.word_hashes(T.LOWER[block.buf], w), return_inverse=True)
    counts = np.bincount(number[learned[w.doc]], minlength=len(keys)).astype(np.int64)
    for bucket, s in B.split_sorted(keys, n):
        yield {"kind": 0, "bucket": bucket, "block_id": block.block_id, "n": s.stop - s.start, "keys": B.squeeze_sorted(keys[s]), "counts": B.squeeze(counts[s])}
    code, at = _codes(block.buf, block.starts)
    if len(code):
        code, order, head = _distinct(code)
        counts = np.add.reduceat(np.repeat(learned, np.diff(block.starts))[at][order].astype(np.int64), head)
        for bucket, i in _by_context(code, n):
            yield {"kind": 1, "bucket": bucket, "block_id": block.block_id, "n": len(i), "keys": B.squeeze_sorted(code[i]), "counts": B.squeeze(counts[i])}


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    head = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] ^ np.uint64(1)))
    return keys[order][head], np.add.reduceat(counts[order], head), order, np.diff(np.append(head, len(keys)))


def _answers(got: dict[str, list], low: Low):
    keys = np.concatenate([B.expand_sorted(x) for x in got["keys"]])
    counts = np.concatenate([B.expand(x, np.int64) for x in got["counts"]])
    distinct, total, order, runs = _summed(keys, counts)
    none = {"block_id": None, "bucket": None, "n": 0, "counts": None, "total": None}
    words = got["kind"][0] == 0
    told = total if words else log_probabilities(distinct, total, low).view(np.uint32)
    back = np.empty(len(keys), told.dtype)
    back[order] = np.repeat(told, runs)
    at = 0
    for block_id, n, bucket in zip(got["block_id"], got["n"], got["bucket"], strict=True):
        yield none | {"kind": got["kind"][0], "block_id": block_id, "bucket": bucket, "n": n, "counts": B.squeeze(back[at : at + n])}
        at += n
    if words:
        yield none | {"kind": 2, "n": int((total > 0).sum()), "total": int(total.sum())}


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learned from rows outside the fold."""
    spark = docs.sparkSession
    blocks = B.pack(docs, id_col, text_col)
    n = B.n_buckets(blocks)

    options = {"gap": ORDER, "fill": FILL}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @B.lean
    def cells(batches):
        """3-byte codes of a task's training documents, a row for each bucket."""
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = B.Block(row, **options)
                learned = np.array([not in_fold(x, modulus, rest) for x in block.ids], bool)
                code, at = _codes(block.buf, block.starts)
                code = np.sort((code[np.repeat(learned, np.diff(block.starts))[at]] & np.uint64(BYTES**3 - 1)).astype(np.uint32))
                if len(code):
                    head = np.flatnonzero(np.diff(code, prepend=~code[:1]))
                    keys, counts = _summed(np.concatenate((keys, code[head].astype(np.uint64))), np.concatenate((counts, np.diff(np.append(head, len(code))))))[:2]
        bucket = T.mix(keys + np.uint64(1)) % np.uint64(parts)
        rows = [{"bucket": int(b), "keys": B.squeeze_sorted(keys[bucket == b]), "counts": B.squeeze(counts[bucket == b])} for b in np.unique(bucket)]
        yield from B.as_batches(iter(rows), _CELLS)

    def added(got: dict[str, list]):
        keys, counts = _summed(np.concatenate([B.expand_sorted(x) for x in got["keys"]]), np.concatenate([B.expand(x, np.int64) for x in got["counts"]]))[:2]
        yield {"bucket": got["bucket"][0], "keys": B.squeeze_sorted(keys), "counts": B.squeeze(counts)}

    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in B.by_bucket(blocks.mapInArrow(cells, _CELLS), added, _CELLS).collect():
        keys.append(B.expand_sorted(bytes(r["keys"])))
        counts.append(B.expand(bytes(r["counts"]), np.int64))
    codes, sums = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(codes)
    codes, sums = codes[order], sums[order]
    ends = int(sums[codes & np.uint64(0xFF) == FILL].sum())
    shared = spark.sparkContext.broadcast((B.squeeze(codes.astype(np.uint32)), B.squeeze(sums)))
    requests = B.from_blocks(blocks, lambda b: _requests(b, n, modulus, rest), _REQUEST, **options)
    answers = B.cut(B.by_bucket(requests, lambda got: _answers(got, _low(shared.value)), _ANSWER, ("kind", "bucket")))
    stats = answers.filter("kind = 2").agg(F.sum("total"), F.sum("n")).first()
    n_train, n_kinds = int(stats[0] or 0) + ends, int(stats[1] or 0) + (ends > 0)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(block: B.Block, told: list[dict]) -> pa.Table:
        w = T.Words(block.buf, block.starts, GAPS)
        keys, number = np.unique(T.word_hashes(T.LOWER[block.buf], w), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        by = {(x["kind"], x["bucket"]): x["counts"] for x in told}
        for bucket, s in B.split_sorted(keys, n):
            counts[s] = B.expand(by[0, bucket], np.int64)
        scale = np.log10(n_train + n_kinds + 1.0)
        logs, known = (np.log10(counts + 1.0) - scale)[number], (counts > 0)[number]
        base = np.bincount(w.doc, logs, minlength=len(block)) + np.log10(ends + 1.0) - scale
        code, at = _codes(block.buf, block.starts)
        lp = np.zeros(len(code))
        if len(code):
            code, order, head = _distinct(code)
            log_p = np.empty(len(code), np.float32)
            for bucket, i in _by_context(code, n):
                log_p[i] = B.expand(by[1, bucket], np.uint32).view(np.float32)
            lp[order] = np.repeat(log_p, np.diff(np.append(head, len(order))))
        sums = np.concatenate(([0.0], np.cumsum(lp)))[np.searchsorted(at, block.starts)]
        held = np.array([in_fold(x, modulus, rest) for x in block.ids], bool)
        columns = [
            pa.array(block.ids, pa.int64()), pa.array(held), pa.array(w.count + 1, pa.int64()), pa.array(np.bincount(w.doc[known], minlength=len(block)) + (ends > 0), pa.int64()),
            pa.array(np.full(len(block), n_train), pa.int64()), pa.array(base), pa.array(np.diff(sums)),
        ]
        return pa.Table.from_arrays(columns, schema=B.arrow_schema(schema))

    return B.with_answers(blocks, answers.filter("kind < 2"), score, schema, **options)

"""Benchmark decontamination with suffix arrays of the training documents.

Each shard of documents (some MB of text) gets a suffix array over its words: all
suffixes of all its documents, sorted by prefix doubling as far as a window goes.
Every suffix of every benchmark item is binary-searched in every shard. The rows
found are verbatim runs with their places; those that follow each other on one
diagonal are joined to the longest match. Documents are not exchanged, so nothing
is skewed by hot passages.

The benchmark is the query set. It goes out in pieces of at most ``piece`` bytes of
text (a longer item is cut, with ``window`` - 1 words in common), never more than
one at a time. One piece, which is the usual case, takes one pass. Of a larger
benchmark each piece takes a pass over packed documents, and the places found are
put together by document; so neither the driver nor a task holds all of it.

Words are compared by 64-bit fingerprints of their bytes; with W benchmark words
and V different training words the chance of any wrong match of one word is
W * V / 2**64, and a match takes ten of them.

Special cases: null and empty texts have no words and no matches; texts of any
length are read whole; an item without words matches nothing; an item with under
``window`` words matches as a whole; equal items each match; null item ids count
under the name "null"; repeated document rows get a row each; an empty benchmark or
table gives no hits or rows. Extra columns, whatever their names, are kept if named
in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from . import blocks as B
from . import text as T

SHARD_BYTES = 4 << 20


def words_of(texts: list[str | None] | pa.Array) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """(words, their fingerprints, folded buffer) of texts."""
    raw, off, _ = T.buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    buf, starts = T.separated(raw, off)
    buf = T.LOWER[buf]
    w = T.Words(buf, starts, T.NOT_ALNUM)
    return w, T.word_hashes(buf, w), buf


class Query:
    """A piece of the benchmark: the fingerprints of its words, and every suffix that is searched."""

    def __init__(self, items: list[tuple[str, str, int]], window: int):
        """Items are (id, text, number of the text's first word in the item)."""
        w, self.words, _ = words_of([t for _, t, _ in items])
        self.window = window
        self.item_ids = [i for i, _, _ in items]
        per = np.where(w.count > 0, np.maximum(1, w.count - window + 1), 0)
        self.item = np.repeat(np.arange(len(items)), per)
        at = np.arange(len(self.item)) - np.repeat(np.cumsum(per) - per, per)
        self.start = w.first[self.item] + at
        #: Number of the suffix's first word in its item, and of words that have to match.
        self.at = at + np.array([o for _, _, o in items], np.int64)[self.item]
        self.size = np.minimum(w.count[self.item], window)


class SuffixArray:
    """All suffixes of a shard's documents in the order of their words, as far as ``depth`` words."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, depth: int):
        self.words, number = np.unique(hashes, return_inverse=True)
        # A 0 follows each document, so that no match runs into the next one.
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(doc) else np.zeros(0, np.int64)
        number = np.insert(number.astype(np.int64) + 1, ends + 1, 0)
        self.place = np.insert(np.arange(len(hashes)), ends + 1, -1)
        self.number = np.append(number, np.zeros(depth, np.int64))
        self.order, rank, step = np.argsort(number, kind="stable"), number, 1
        while step < depth and len(rank):
            after = np.zeros(len(rank), np.int64)
            after[:-step] = rank[step:]
            key = rank * (int(rank.max()) + 1) + after
            self.order = np.argsort(key)
            new = np.diff(key[self.order], prepend=-1) != 0
            rank = np.empty(len(key), np.int64)
            rank[self.order] = np.cumsum(new)
            step *= 2

    def compare(self, row: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-1, 0, 1: the suffix in each row of the array before, beginning with, or after the searched one."""
        at, out = self.order[row], np.zeros(len(row), np.int64)
        for k in range(int(size.max()) if len(size) else 0):
            other = self.number[at + k]
            mine = np.where(k < size, words[np.minimum(start + k, len(words) - 1)], other)
            out = np.where(out == 0, np.sign(other - mine), out)
        return out

    def bound(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, low: np.ndarray, beyond: bool) -> np.ndarray:
        """By binary search, the first row from ``low`` on that is not before (with ``beyond``: that is after) each searched suffix."""
        lo, hi = low.copy(), np.full(len(start), len(self.order))
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) >> 1
            c = self.compare(mid, words, start[live], size[live])
            up = c <= 0 if beyond else c < 0
            lo[live[up]], hi[live[~up]] = mid[up] + 1, mid[~up]
        return lo

    def search(self, query: Query) -> tuple[np.ndarray, np.ndarray]:
        """(suffix number, word position) of every place where a whole suffix stands."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.words) or not len(query.start):
            return none
        where = np.minimum(np.searchsorted(self.words, query.words), len(self.words) - 1)
        known = self.words[where] == query.words
        words = where + 1
        # Suffixes with a word that the shard does not have stand nowhere.
        missing = np.concatenate(([0], np.cumsum(~known)))
        q = np.flatnonzero(missing[query.start + query.size] == missing[query.start])
        low = self.bound(words, query.start[q], query.size[q], np.zeros(len(q), np.int64), False)
        inside = np.flatnonzero(low < len(self.order))
        q, low = q[inside], low[inside]
        here = self.compare(low, words, query.start[q], query.size[q]) == 0
        q, low = q[here], low[here]
        n = self.bound(words, query.start[q], query.size[q], low, True) - low
        row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(q, n), self.place[self.order[row]]


def pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int, least: int, piece: int) -> Iterator[Query]:
    """The query set, in pieces of at most ``piece`` bytes of text."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        name = "null" if item is None else item
        if least > 1 and len(words_of([text])[0]) < least:
            continue
        for part, first in parts(text or "", window, piece):
            n = len(part.encode())
            if held and size + n > piece:
                yield Query(held, window)
                held, size = [], 0
            held.append((name, part, first))
            size += n
    if held:
        yield Query(held, window)


def parts(text: str, window: int, piece: int) -> Iterator[tuple[str, int]]:
    """(text, number of its first word): the item, or runs of its words that have ``window`` - 1 in common."""
    if len(text) * 4 <= piece or len(text.encode()) <= piece:
        yield text, 0
        return
    w, _, buf = words_of([text])
    step = max(window, len(w) * piece // (2 * len(buf)))
    for first in range(0, max(1, len(w) - window + 1), step):
        last = min(first + step + window - 1, len(w)) - 1
        yield buf[w.start[first] : w.end[last]].tobytes().decode() if last >= first else "", first


def joined(matches: list[dict]) -> list[dict]:
    """Runs of one item and document on one diagonal that overlap, as one longest match each."""
    out: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["item"], m["doc_word"] - m["item_word"], m["doc_word"])):
        last = out[-1] if out else None
        if last and last["item"] == m["item"] and last["doc_word"] - last["item_word"] == m["doc_word"] - m["item_word"] and m["doc_word"] <= last["doc_word"] + last["n_words"]:
            last["n_words"] = max(last["n_words"], m["doc_word"] + m["n_words"] - last["doc_word"])
        else:
            out.append(dict(m))
    return sorted(out, key=lambda m: (m["doc_word"], m["item"], m["item_word"], m["n_words"]))


def found_in(w: T.Words, h: np.ndarray, n: int, query: Query, array: SuffixArray) -> tuple[np.ndarray, list[set], list[list]]:
    """(whether each word is hit, items of each document, matches of each document) of a shard of n documents."""
    hit = np.zeros(len(w), bool)
    items: list[set] = [set() for _ in range(n)]
    matches: list[list] = [[] for _ in range(n)]
    q, p = array.search(query)
    if not len(q):
        return hit, items, matches
    for size in np.unique(query.size[q]).tolist():
        hit |= T.covered(len(w), p[query.size[q] == size], size)
    doc = w.doc[p]
    for d, k in np.unique(np.stack((doc, query.item[q])), axis=1).T.tolist():
        items[d].add(query.item_ids[k])
    diagonal = p - query.at[q]
    order = np.lexsort((p, diagonal, query.item[q], doc))
    q, p, doc, diagonal = q[order], p[order], doc[order], diagonal[order]
    head = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(query.item[q]) != 0) | (np.diff(diagonal) != 0) | (np.diff(p) != 1)))
    last = np.append(head[1:], len(q)) - 1
    for a, z in zip(head.tolist(), last.tolist(), strict=True):
        d = int(doc[a])
        matches[d].append({"item": query.item_ids[query.item[q[a]]], "item_word": int(query.at[q[a]]), "doc_word": int(p[a] - w.first[d]), "n_words": int(p[z] - p[a] + query.size[q[z]])})
    return hit, items, matches


_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, matches array<struct<item: string, item_word: bigint, doc_word: bigint, n_words: bigint>>, contaminated boolean"
_PLACES = "block_id long, row long, items array<string>, item_of array<bigint>, item_word array<bigint>, doc_word array<bigint>, n_words array<bigint>"


def _columns(ids: pa.Array, w: T.Words, hit: np.ndarray, items: list[set], matches: list[list]) -> list[pa.Array]:
    n_hit = np.bincount(w.doc[hit], minlength=len(items))
    return [
        ids, pa.array(w.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([joined(x) for x in matches], pa.list_(_MATCH)), pa.array(n_hit > 0),
    ]


def _schema(docs: DataFrame, carry: tuple[str, ...]) -> T_.StructType:
    out = T_.StructType.fromDDL(_RESULT)
    for k, c in enumerate(carry):
        out.add(f"c{k}", docs.schema[c].dataType)
    return out


def _one_pass(docs: DataFrame, query: Query, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    schema = _schema(docs, carry)
    names, other = schema.names, [f"c{k}" for k in range(len(carry))]
    shared = docs.sparkSession.sparkContext.broadcast(query)

    def shard(part: pa.RecordBatch) -> pa.RecordBatch:
        w, h, _ = words_of(part.column("text"))
        array = SuffixArray(h, w.doc, shared.value.window)
        own = _columns(part.column("doc_id"), w, *found_in(w, h, part.num_rows, shared.value, array))
        return pa.RecordBatch.from_arrays([*own, *(part.column(c) for c in other)], names=names)

    @B.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SHARD_BYTES):
                yield shard(part)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, other, strict=True)])
    return rows.mapInArrow(run, schema)


def _many_passes(docs: DataFrame, queries: Iterator[Query], id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    schema = _schema(docs, carry)
    names = schema.names
    blocks = B.pack(docs, id_col, text_col, carry)
    every = None
    for query in queries:
        shared = docs.sparkSession.sparkContext.broadcast(query)

        def places(block: B.Block, shared=shared) -> Iterator[dict]:
            buf = T.LOWER[block.buf]
            w = T.Words(buf, block.starts, T.NOT_ALNUM)
            h = T.word_hashes(buf, w)
            _, items, matches = found_in(w, h, len(block), shared.value, SuffixArray(h, w.doc, shared.value.window))
            for row, (names, runs) in enumerate(zip(items, matches, strict=True)):
                if names:
                    listed = sorted(names)
                    at = {x: i for i, x in enumerate(listed)}
                    yield {"block_id": block.block_id, "row": row, "items": listed, "item_of": [at[m["item"]] for m in runs], **{c: [m[c] for m in runs] for c in ("item_word", "doc_word", "n_words")}}

        got = B.cut(B.from_blocks(blocks, places, _PLACES))
        shared.destroy()
        every = got if every is None else every.unionByName(got)

    def combine(block: B.Block, rows: list[dict]) -> pa.Table:
        buf = T.LOWER[block.buf]
        w = T.Words(buf, block.starts, T.NOT_ALNUM)
        hit = np.zeros(len(w), bool)
        items: list[set] = [set() for _ in range(len(block))]
        matches: list[list] = [[] for _ in range(len(block))]
        for r in rows:
            items[r["row"]].update(r["items"])
            for k, a, d, n in zip(r["item_of"], r["item_word"], r["doc_word"], r["n_words"], strict=True):
                matches[r["row"]].append({"item": r["items"][k], "item_word": a, "doc_word": d, "n_words": n})
                hit[w.first[r["row"]] + d : w.first[r["row"]] + d + n] = True
        return pa.Table.from_arrays([*_columns(pa.array(block.ids, pa.int64()), w, hit, items, matches), *(block.carried.columns if carry else ())], names=names)

    return B.with_answers(blocks, every, combine, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, least: int = 1, piece: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, matches, contaminated) and the columns ``carry``.

    ``items`` are the ids, as sorted strings, of items with a window in the document; ``matches`` the longest verbatim
    matches, as item, first word in the item, first word in the document, number of words. Items of under ``least``
    words are left out.
    """
    queries = pieces(benchmark, item_col, item_text_col, window, least, piece)
    first = next(queries, None) or Query([], window)
    second = next(queries, None)
    if second is None:
        got = _one_pass(docs, first, id_col, text_col, carry)
    else:
        got = _many_passes(docs, chain((first, second), queries), id_col, text_col, carry)
    return got.select(*T_.StructType.fromDDL(_RESULT).names, *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])

"""Ranked lexical search by MaxScore over the inverted index of each shard.

``build_index`` reads the texts once. A shard is a run of rows of some MB of text;
its index holds, for each term's fingerprint, the list of documents with that term
and its occurrences, as packed arrays in one row of a table in the checkpoint folder.
``search`` first adds up, over all shards, the numbers of documents and terms and,
for the terms of the query set, the document frequencies. Then each shard answers
every query. The query's lists get an upper bound each, their highest contribution
within the shard. Lists in ascending order of bounds whose sum is below the least
score that still counts are non-essential: a document in these alone cannot qualify.
So candidates come from the essential lists only; non-essential lists are probed from
the highest bound down, for those candidates whose score plus all bounds left still
reaches the least score. That rises while a task works through its shards, so that
later shards open fewer lists. Documents are taken in ranges that double, the first
ones being short, to find good scores early. A task sends its best documents of each
query on; they are ranked in two steps, groups of tasks first.

Bounds are compared so that equal scores are never dropped: ties go by id exactly.
A query set beyond ``PIECE`` bytes goes past the index piece by piece.

Special cases: null and empty texts have no terms, are not counted and never found;
a null or empty query finds nothing; a null document id is ranked last of equal
scores; repeated documents are ranked each by itself, repeated queries answered each;
texts of any length are indexed whole; an empty table gives an empty result; extra
columns, whatever their names, are not read. Terms are told apart by 64-bit
fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T

SHARD_BYTES = 8 << 20
#: Bytes of query texts that are sent to all tasks at once.
PIECE = 4 << 20
FIRST_RANGE = 256
INDEX = "shard long, n_docs long, n_terms long, ids array<bigint>, length binary, terms binary, count binary, doc binary, tf binary"
FOUND = "query long, item_id string, doc_id bigint, score bigint, task long"


# -- index ------------------------------------------------------------------


def terms_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of each term, its document, terms of each document): runs of ASCII digits and letters, lower-cased, and all non-ASCII bytes."""
    buf, starts = T.separated(raw, off)
    buf = T.LOWER[buf]
    w = T.Words(buf, starts, T.NOT_ALNUM)
    return T.word_hashes(buf, w), w.doc, w.count


def shard_of(part: pa.RecordBatch, number: int) -> dict:
    """The index of a run of rows: documents in the order of their ids, those without terms left out."""
    raw, off, _ = T.buffers(part.column("text"))
    h, doc, count = terms_of(raw, off)
    ids = part.column("doc_id").to_pylist()
    live = sorted(np.flatnonzero(count).tolist(), key=lambda d: (ids[d] is None, ids[d] or 0))
    place = np.zeros(len(ids), np.int64)
    place[live] = np.arange(len(live))
    doc = place[doc]
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    head = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(doc) != 0))) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.append(head, len(h)))
    h, doc = h[head], doc[head]
    first = np.flatnonzero(np.append(True, np.diff(h) != 0)) if len(h) else head
    return {
        "shard": number, "n_docs": len(live), "n_terms": int(count.sum()), "ids": [ids[d] for d in live], "length": B.squeeze(count[live].astype(np.int64)), "terms": B.squeeze_sorted(h[first]),
        "count": B.squeeze(np.diff(np.append(first, len(h))).astype(np.int32)), "doc": B.squeeze(doc.astype(np.int32)), "tf": B.squeeze(tf.astype(np.int32)),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard, kept in the checkpoint folder."""

    @B.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            row = shard_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], number)
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], B.arrow_schema(INDEX))

        for batch in batches:
            for part in T.slices(batch, "text", SHARD_BYTES):
                n = part.column("text").nbytes
                if held and size + n > SHARD_BYTES:
                    yield flush()
                held.append(part)
                size += n
        if held:
            yield flush()

    return B.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX))


class Shard:
    """Lists of the terms of one shard."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.terms = B.expand_sorted(row["terms"])
        self.ends = np.cumsum(B.expand(row["count"], np.int32), dtype=np.int64)
        if "doc" in row:
            self.length = B.expand(row["length"], np.int64)
            self.doc = B.expand(row["doc"], np.int32)
            self.tf = B.expand(row["tf"], np.int32)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the terms it has, where their lists begin, where they end)"""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        has = np.flatnonzero(self.terms[at] == terms)
        end = self.ends[at[has]]
        return has, end - np.diff(self.ends, prepend=0)[at[has]], end


# -- search -----------------------------------------------------------------


class Queries:
    """A piece of the query set: ids as text, and the distinct terms of each as numbers into the piece's terms."""

    def __init__(self, rows: list[tuple[int, str | None, str]]):
        self.number, self.item = [r[0] for r in rows], [r[1] for r in rows]
        raw, off, _ = T.buffers(pa.array([r[2] for r in rows], pa.string()))
        h, doc, _ = terms_of(raw, off)
        self.terms, index = np.unique(h, return_inverse=True)
        self.of = [np.unique(index[doc == q]) for q in range(len(rows))] if len(rows) < 64 else [np.unique(x) for x in np.split(index, np.searchsorted(doc, np.arange(1, len(rows))))]
        self.weight = np.zeros(len(self.terms), np.int64)


def pieces(queries: DataFrame, id_col: str, text_col: str, piece: int) -> Iterator[Queries]:
    held, size = [], 0
    for number, (item, text) in enumerate(queries.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator()):
        n = len((text or "").encode())
        if held and size + n > piece:
            yield Queries(held)
            held, size = [], 0
        held.append((number, item, text or ""))
        size += n
    if held:
        yield Queries(held)


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents with each of the terms, over all shards: sums of each task's shards, added up term by term."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                has, start, end = Shard(row).find(shared.value)
                total[has] += end - start
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    got = index.select("terms", "count", F.array().cast("array<bigint>").alias("ids")).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out[got["term"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    shared.destroy()
    return out


def length_norm(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + ((90 * n * N) div L); in whole numbers of any size where 64 bits do not hold the product."""
    if len(length) and 90 * int(length.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(n) * n_docs // n_terms for n in length], np.int64)
    return 10 + 90 * length * n_docs // max(n_terms, 1)


def contributions(weight: int, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * norm))


class Best:
    """The documents of highest score found so far, equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A document below this does not count any more."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows = sorted([*self.rows, *zip(scores.tolist(), ids, strict=True)], key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: list, best: Best) -> None:
    """``lists``: (ascending documents, contributions) of a query's terms in one shard. Puts those that qualify into ``best``."""
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    bound = np.cumsum([int(x[1].max()) for x in lists])
    at, size = 0, FIRST_RANGE
    while at < n_docs:
        to = min(n_docs, at + size)
        least = best.least
        essential = int(np.searchsorted(bound, least, "left"))  # the first list with which the sum of bounds reaches the least score
        if essential == len(lists):
            return
        cuts = [np.searchsorted(d, (at, to)) for d, _ in lists]
        score = np.zeros(to - at, np.int64)
        for (d, c), (lo, hi) in zip(lists[essential:], cuts[essential:], strict=True):
            score[d[lo:hi] - at] += c[lo:hi]
        found = np.flatnonzero(score)
        score = score[found]
        for j in range(essential - 1, -1, -1):
            may = score + bound[j] >= least
            found, score = found[may], score[may]
            if not len(found):
                break
            d, c = lists[j]
            lo, hi = cuts[j]
            if hi > lo:
                where = np.minimum(np.searchsorted(d[lo:hi], found + at), hi - lo - 1) + lo
                score = score + np.where(d[where] == found + at, c[where], 0)
        good = np.flatnonzero(score >= least)
        if len(good) > best.k:
            # Equal scores stay in the order of ids, so that the first of them are the ones that count.
            good = good[np.argsort(-score[good], kind="stable")[: best.k]]
        if len(good):
            best.add(score[good], [ids[at + i] for i in found[good].tolist()])
        at, size = to, 2 * size


def answers(index: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score, task): the best of each task for each query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    @B.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = [Best(k) for _ in q.of]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                norm = length_norm(shard.length, n_docs, n_terms)
                has, start, end = shard.find(q.terms)
                lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for t, lo, hi in zip(has.tolist(), start.tolist(), end.tolist(), strict=True):
                    if q.weight[t]:
                        doc = shard.doc[lo:hi]
                        lists[t] = doc, contributions(int(q.weight[t]), shard.tf[lo:hi], norm[doc])
                for terms, b in zip(q.of, best, strict=True):
                    if own := [lists[t] for t in terms.tolist() if t in lists]:
                        max_score(own, len(shard.ids), shard.ids, b)
        task = TaskContext.get().partitionId()
        rows = [{"query": q.number[i], "item_id": q.item[i], "doc_id": d, "score": s, "task": task} for i, b in enumerate(best) for s, d in b.rows]
        yield pa.RecordBatch.from_pylist(rows, B.arrow_schema(FOUND))

    return index.select("ids", "length", "terms", "count", "doc", "tf").mapInArrow(run, FOUND)


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, piece: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each query."""
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    every = None
    for q in pieces(queries, id_col, text_col, piece or PIECE):
        df = frequencies(index, q.terms)
        q.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        got = answers(index, q, n_docs, n_terms, k)
        every = got if every is None else every.unionByName(got)
    if every is None:
        every = index.sparkSession.createDataFrame([], FOUND)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = every.withColumn("part", F.pmod("task", F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("r") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(queries.schema[id_col].dataType).alias("item_id"), "rank", "doc_id", "score")

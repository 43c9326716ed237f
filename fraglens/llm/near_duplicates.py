"""SimHash near-duplicates held to a similarity: operator 10 for sets of five-word shingles and a Jaccard similarity of 0.8 or more.

Words are told apart after ASCII lower-casing; a text of fewer words than a shingle
is one shingle. Texts with equal sets are one row before anything is compared.
Candidates are pairs whose 64-bit SimHash fingerprints, of the distinct shingles,
are equal or linked by the Golay code's keys (see simhash.py). Two sets of similarity
0.8 are some ten bits apart, and Golay keys that bridge ten bits of 64 with certainty
would be in the thousands for each text, so that the fingerprints alone find the
closer pairs only (of those at 0.80, 0.85 and 0.90 about 8, 17 and 33 %). So the
buckets of MinHash bands are resolved too, as in minhash.py: of 50 bands of seven
coordinates, a pair of similarity 0.8 shares none with probability 8e-6. A pair is
linked only if the exact similarity of its whole sets reaches the threshold; sets meet
pair by pair, and a bucket's members only its pivots. The links' components are found
in Spark tables.

Special cases: null and empty texts have the empty set and are alike; texts of any
length are compared whole; a similarity of just 0.8 is a link; a null id takes part
with its text, and counts as smallest id only where no other is there; repeated rows
get a row each; an empty table gives an empty result; extra columns, whatever their
names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import minhash
from . import text as T
from .shingles import set_ids, shingle_sets
from .simhash import near_links

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
SLICE_BYTES = 2 << 20


def set_fingerprints(value: np.ndarray, bounds: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """64-bit SimHash of each set: a bit is 1 if set in over half the values."""
    size = np.diff(bounds)
    sums = np.zeros((len(size), 64), np.int64)
    for at in range(0, len(value), step):
        bit = np.unpackbits(value[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = int(np.searchsorted(bounds, at, "right")) - 1
        hi = int(np.searchsorted(bounds, at + len(bit), "left"))
        cuts = np.clip(bounds[lo:hi] - at, 0, len(bit))
        live = np.flatnonzero(np.diff(np.append(cuts, len(bit))))
        sums[lo + live] += np.add.reduceat(bit, cuts[live], axis=0, dtype=np.int32)
    packed = np.packbits(2 * sums > size[:, None], axis=1, bitorder="little")
    return packed.reshape(-1).view(np.int64) if len(packed) else np.zeros(0, np.int64)


def content_of(text: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, sid) of all rows and (sid, root, least) of all sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), content_of(text_col).alias("content"))

    @B.lean
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, n = zstandard.ZstdCompressor(level=1), minhash.BANDS
        for batch in batches:
            for part in T.slices(batch, "text", SLICE_BYTES):
                raw, off, _ = T.buffers(part.column("text"))
                value, bounds = shingle_sets(raw, off, SHINGLE)
                keys = minhash.band_keys(minhash.sketches(value, bounds))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n), pa.array(keys.reshape(-1)))
                view = raw.tobytes()
                body = pa.array([press.compress(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
                columns = {"doc_id": part.column("doc_id"), "content": part.column("content"), "sid": pa.array(set_ids(value, bounds)), "fp": pa.array(set_fingerprints(value, bounds)), "size": pa.array(np.diff(bounds), pa.int64()), "keys": listed, "body": body}
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    table = B.cut(rows.mapInArrow(mapped, "doc_id bigint, content bigint, sid bigint, fp bigint, size bigint, keys array<bigint>, body binary"))
    distinct = B.cut(table.groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    some = distinct.filter("size > 0").select("sid", "fp")
    # Sets of one fingerprint are tried with the first, and the firsts of linked fingerprints with each other.
    one = B.cut(some.groupBy("fp").agg(F.min("sid").alias("a")))
    alike = some.join(one, "fp").filter("a < sid").select("a", F.col("sid").alias("b"))
    close = near_links(one.select("fp")).withColumnsRenamed({"a": "x", "b": "y"}).join(one.withColumnRenamed("fp", "x"), "x").join(one.select(F.col("fp").alias("y"), F.col("a").alias("b")), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = B.cut(alike.unionByName(close).distinct())
    del one, alike, close, some
    B.let_go(docs.sparkSession)
    root = minhash.components(table, SHINGLE, LEAST, more)
    roots = distinct.select("sid", "least").join(root.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "least")
    return table.select("doc_id", "content", "sid"), roots


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): all documents, with the smallest id reachable over pairs of the least similarity."""
    table, roots = _grouped(docs, id_col, text_col)
    label = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.select("doc_id", "sid").join(roots.join(label, "root").select("sid", "component_id"), "sid", "left").select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row for each group: that with the least id (none comes last), of rows of that id one text, of repeated rows one."""
    table, roots = _grouped(docs, id_col, text_col)
    every = table.join(roots.select("sid", "root"), "sid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("f")
    firsts = B.cut(every.groupBy("root").agg(first, F.count("*").alias("n")).select(F.col("f.doc_id").alias("id_"), F.col("f.content").alias("content_"), "n"))
    named = docs.withColumn("content_", content_of(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("id_")) & (named["content_"] == firsts["content_"])
    kept = named.join(firsts, same, "left_semi")
    # Rows that are repeated word for word all match; they are made one only where there are any.
    again = table.groupBy("doc_id", "content").count().filter("count > 1")
    if again.limit(1).count():
        kept = kept.dropDuplicates([id_col, "content_"])
    return kept.select(*docs.columns)

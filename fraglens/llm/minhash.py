"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A set's sketch has ``COORDINATES`` values. In each round every element is hashed anew
to one of them and leaves its hash there if that is the least of the first round
which reached the coordinate; rounds end when all are filled. The first t rounds
choose coordinates by hashing, which takes about t ln t hashes instead of t for each
element; round t + i puts every element on coordinate i, so that 2t rounds always
fill all. Two sets agree in a coordinate with a probability that equals their
similarity, and the share of equal coordinates is as concentrated as that of
independent ones.

Bands of ``ROWS`` coordinates are keys. Of 50 bands of 7, a pair of similarity 0.8
shares none with probability 8e-6, one of 0.85 with 4e-9, while one of 0.3 shares any
with 0.01. Texts with equal sets are one row before any key is made. A pair is linked
if the exact similarity of its whole sets reaches the threshold. Pairs are never listed:
* first each set meets one pivot, the smallest of all sets that lead a bucket of it;
  what is linked is a component, which for most groups of copies is all of them;
* then only buckets that hold several components count, and of their pairs those
  between components: members outside a bucket's largest component meet all others.
  Both sides are cut into blocks of ``BLOCK`` sets, a task compares two blocks, and
  sends only links that join components, so that a hot bucket is dealt out over many
  tasks and its largest component costs a pass over it;
* members of buckets beyond ``LARGE`` meet under their rarest elements instead of their
  bands: of two sets of similarity s, both have a common element among their first
  (1 - s) n + 1 in any order of all elements. In order of frequency, a passage that
  many documents share is no key, so unlike sets part. Nothing is lost.

Special cases: null texts and texts without words have the empty set and are linked
with nothing, not even each other; fewer words than a shingle are one shingle; texts
of any length are compared whole; a similarity of just the threshold is a link; a
null id takes part with its text, and is the component's id only where no other is
there, and is then kept; repeated rows get a row each; an empty table gives an empty
result; extra columns, whatever their names, are not carried. Shingles are told apart
by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T
from .components import connected_components
from .shingles import set_ids, shingle_sets

BANDS, ROWS = 50, 7
COORDINATES = BANDS * ROWS
SLICE_BYTES = 2 << 20
#: Sets in a block of a bucket; members of a bucket that is filed anew.
BLOCK, LARGE = 512, 4096
_rng = np.random.RandomState(20170707)
_SEED = _rng.randint(0, 2**63 - 1, 2 * COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(T.MASK64)
_LOW = np.uint64((1 << 48) - 1)


def sketches(value: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t values for each set; a value has its round in the upper 16 bits. Those of an empty set are all the largest."""
    n = len(bounds) - 1
    out = np.full(n * t, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    for r in range(2 * t):
        if not len(value):
            break
        h = T.mix(value ^ _SEED[r])
        at = doc * t + (((h >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)).astype(np.int64) if r < t else r - t)
        free = out[at] >= np.uint64(r << 48)  # not of an earlier round
        np.minimum.at(out, at[free], (h[free] & _LOW) | np.uint64(r << 48))
        wanting = (out.reshape(n, t) == _EMPTY).any(axis=1)
        if not wanting[doc].all():
            keep = wanting[doc]
            value, doc = value[keep], doc[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each set and band."""
    rows = sketch.shape[1] // bands
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            acc = T.mix(acc * np.uint64(T.WORD_BASE) + sketch[:, k::rows][:, :bands])
    return acc.view(np.int64)


def _rows(docs: DataFrame, shingle: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sid, size, keys, body): each document's set by its fingerprint, its band keys and its compressed text."""

    @B.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in T.slices(batch, "text", SLICE_BYTES):
                raw, off, _ = T.buffers(part.column("text"))
                value, bounds = shingle_sets(raw, off, shingle)
                keys = band_keys(sketches(value, bounds), bands)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                view = raw.tobytes()
                body = pa.array([press.compress(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(set_ids(value, bounds)), pa.array(np.diff(bounds), pa.int64()), listed, body], names=["doc_id", "sid", "size", "keys", "body"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return B.cut(rows.mapInArrow(run, "doc_id bigint, sid bigint, size bigint, keys array<bigint>, body binary"))


def _may(x: str | Column, y: str | Column, least: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be so similar."""
    return least[1] * F.least(x, y) >= least[0] * F.greatest(x, y)


def joining_links(sid: np.ndarray, part: np.ndarray, minor: np.ndarray, value: np.ndarray, bounds: np.ndarray, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between sets of different components of which one is ``minor`` at least; of those that join the same components, one."""
    size = np.diff(bounds)
    number = np.unique(value, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(size)), size)
    root = np.unique(part, return_inverse=True)[1]
    mark = np.zeros(int(number.max()) + 1 if len(number) else 0, bool)
    out = []
    for i in np.flatnonzero(minor).tolist():
        if (root == root[i]).all():
            break
        mine = number[bounds[i] : bounds[i + 1]]
        mark[mine] = True
        both = np.bincount(owner[mark[number]], minlength=len(size))
        mark[mine] = False
        near = np.flatnonzero((least[1] * both >= least[0] * (size + size[i] - both)) & (root != root[i]))
        for j in near.tolist():
            if root[j] != root[i]:
                out.append((int(sid[i]), int(sid[j])))
                root[root == root[j]] = root[i]
    return out


def compared(rows: DataFrame, bodies: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): links of the buckets (key, sid, part, minor), between minor members and all others of other components."""
    block = BLOCK
    counts = B.cut(rows.groupBy("key").agg(F.ceil(F.count_if("minor") / block).cast("int").alias("m"), F.ceil(F.count("*") / block).cast("int").alias("n")))
    place = lambda k: F.pmod(F.xxhash64("sid"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    sized = rows.join(counts, "key")
    columns = sized.withColumn("j", place("n")).withColumn("i", every("m")).select("key", "i", "j", "sid", "part", F.lit(False).alias("minor"))
    lines = sized.filter("minor").withColumn("i", place("m")).withColumn("j", every("n")).select("key", "i", "j", "sid", "part", "minor")
    met = lines.unionByName(columns).join(bodies, "sid")

    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        order = np.lexsort((~np.asarray(table.column("minor").combine_chunks().to_numpy(zero_copy_only=False)), np.asarray(table.column("sid").combine_chunks())))
        table = table.take(pa.array(order))
        sid, part, minor = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("sid", "part", "minor"))
        once = np.append(True, sid[1:] != sid[:-1]) if len(sid) else np.zeros(0, bool)  # a minor member that is in both blocks counts as one
        raw, off, _ = T.buffers(pa.array([open_.decompress(x.as_py()) for x in table.column("body").filter(pa.array(once))], pa.large_binary()))
        got = joining_links(sid[once], part[once], minor[once], *shingle_sets(raw, off, shingle), least)
        out = pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})
        B.release()
        return out

    return met.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def by_rarest(members: DataFrame, bodies: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(key, sid, part): the sets of ``members`` (sid, size, part) under so many of their rarest elements that two of the least similarity have one in common."""

    @B.lean
    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in T.slices(batch, "body", SLICE_BYTES >> 3):
                open_ = zstandard.ZstdDecompressor()
                raw, off, _ = T.buffers(pa.array([open_.decompress(x.as_py()) for x in own.column("body")], pa.large_binary()))
                value, bounds = shingle_sets(raw, off, shingle)
                at = pa.array(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([own.column("sid").take(at), own.column("size").take(at), own.column("part").take(at), pa.array(value.view(np.int64))], names=["sid", "size", "part", "key"])

    each = B.cut(members.select("sid", "size", "part").distinct().join(bodies, "sid").mapInArrow(elements, "sid bigint, size bigint, part bigint, key bigint"))
    often = B.cut(each.groupBy("key").agg(F.count("*").alias("df")))
    n = F.expr(f"cast(size - ({least[0]} * size + {least[1] - 1}) div {least[1]} + 1 as int)")
    first = each.join(often, "key").groupBy("sid", "size", "part").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ranked")).select("sid", "part", F.explode(F.slice("ranked", F.lit(1), n)).alias("r"))
    return first.filter("r.df > 1").select("r.key", "sid", "part")


def components(table: DataFrame, shingle: int, least: tuple[int, int], more: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets that are linked with any, from the rows (sid, size, keys, body) of all documents; ``more`` are pairs (a, b) to try besides those of the bands."""
    distinct = table.filter("size > 0").groupBy("sid").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    bands = B.cut(distinct.select("sid", "size", F.explode("keys").alias("key")))
    heads = B.cut(bands.groupBy("key").agg(F.min(F.struct("sid", "size")).alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head"))
    members = B.cut(bands.join(heads, "key"))
    del bands, heads
    B.let_go(table.sparkSession)
    first = members.filter((F.col("head.sid") < F.col("sid")) & _may("size", "head.size", least)).groupBy(F.col("sid").alias("b")).agg(F.min("head.sid").alias("a")).select("a", "b")
    some = members.select("sid")
    if more is not None:
        first = first.unionByName(more.select("a", "b")).distinct()
        some = some.unionByName(more.select(F.explode(F.array("a", "b")).alias("sid")))
    bodies = B.cut(table.select("sid", "body").join(some.distinct(), "sid", "left_semi").dropDuplicates(["sid"]))
    first = B.cut(first)
    pivots = first.select(F.col("a").alias("key"), F.col("a").alias("sid"), F.col("a").alias("part"), F.lit(True).alias("minor")).distinct()
    begun = pivots.unionByName(first.select(F.col("a").alias("key"), F.col("b").alias("sid"), F.col("b").alias("part"), F.lit(False).alias("minor")))
    links = B.cut(compared(begun, bodies, shingle, least))
    root = B.cut(connected_components(links).select("node", "root"))
    named = members.join(root.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "size", F.coalesce("root", "sid").alias("part"))
    shares = B.cut(named.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", "n").alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main", "n"))
    most = shares.agg(F.max("n")).first()[0]
    if most is None:
        return root
    left = B.cut(named.join(shares, "key"))
    rows = left.filter(F.col("n") <= LARGE).select("key", "sid", "part", (F.col("part") != F.col("main")).alias("minor"))
    if most > LARGE:
        filed = B.cut(by_rarest(left.filter(F.col("n") > LARGE), bodies, shingle, least))
        main = B.cut(filed.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", "n").alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main"))
        rows = rows.unionByName(filed.join(main, "key").select("key", "sid", "part", (F.col("part") != F.col("main")).alias("minor")))
    found = B.cut(compared(B.cut(rows), bodies, shingle, least))
    if found.isEmpty():
        return root
    known = root.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return B.cut(connected_components(known.unionByName(found)).select("node", "root"))


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, least: tuple[int, int] = (80, 100), bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): all documents, with the smallest id reachable over pairs of the least similarity; ``kept`` tells the one with that id."""
    table = _rows(docs, shingle, bands, id_col, text_col)
    root = components(table, shingle, least)
    rows = table.select("doc_id", "sid", "size")
    of = rows.filter("size > 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(root.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "least")
    of = B.cut(of)
    label = B.cut(of.groupBy("root").agg(F.min("least").alias("component_id")))
    named = B.cut(of.join(label, "root").select("sid", "component_id"))
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(named, "sid", "left").select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

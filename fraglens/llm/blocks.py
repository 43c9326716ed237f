"""Packed blocks of documents and packed requests between blocks and hash buckets.

A corpus-wide statistic of words or windows needs every occurrence to meet its
equals. Sent as rows that is a row for each word. Here documents are packed into
blocks of some MB of compressed text; each block sends every hash bucket one
binary request with its distinct keys, sorted, as differences. Buckets answer
with a bit or a number for each key, and blocks read the answers in key order.
A key that occurs in a third of all documents is one entry for each block, so no
bucket gets hot, and the text is shuffled only as compressed blocks.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from . import text as T

BLOCK_SCHEMA = "block_id long, ids array<bigint>, lengths binary, payload binary, carried binary, n_bytes long"
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Spark's setting by which a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a temporary one if all runs in one process; on a cluster, whose executors share no local folder, an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fraglens-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder; the shuffle files that led to them go at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    given = spark.conf.get(END_SHUFFLES, "false")
    spark.conf.set(END_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own, since the setting holds for those made under it
    finally:
        spark.conf.set(END_SHUFFLES, given)


def let_go(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete checkpoints that nothing refers to any more: it waits for the driver's garbage collection, which one with memory to spare puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable) -> Callable:
    """The same function of batches, which afterwards gives freed memory back: workers live on for later stages."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return trimmed


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


# -- packing of arrays ------------------------------------------------------


def squeeze(a: np.ndarray) -> bytes:
    """An integer array, byte plane by byte plane, compressed; planes of zeros cost next to nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.uint64), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


# -- blocks -----------------------------------------------------------------


class Block:
    """Documents of one block: ids (None allowed), null flags, separated text buffer and document starts."""

    def __init__(self, row: dict, gap: int = 1, fill: int = T.SPACE):
        self.block_id = row["block_id"]
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.nulls = lengths < 0
        off = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=max(1, int(off[-1]))), np.uint8)
        self.buf, self.starts = T.separated(raw, off, gap, fill)
        self.carried = pa.ipc.open_stream(row["carried"]).read_all() if row.get("carried") else None
        self.id_nulls = np.array([x is None for x in self.ids], bool)
        self.id = np.array([0 if x is None else x for x in self.ids], np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of whole documents, kept in the checkpoint folder, so that a block means the same rows in all later passes.

    Other columns, named in ``carry``, travel along.
    """
    other = [f"c{i}" for i in range(len(carry))]

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pa.Array, np.ndarray, bytes, pa.RecordBatch]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            ids = pa.concat_arrays([h[0] for h in held]).to_pylist()
            lengths = np.concatenate([h[1] for h in held]).astype(np.int64)
            payload = zstandard.ZstdCompressor(level=3).compress(b"".join(h[2] for h in held))
            carried = b""
            if other:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0][3].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    for h in held:
                        out.write_batch(h[3])
                carried = sink.getvalue().to_pybytes()
            row = pa.RecordBatch.from_arrays(
                [pa.array([base + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()), pa.array([payload], pa.binary()), pa.array([carried], pa.binary()), pa.array([int(np.maximum(lengths, 0).sum())], pa.int64())],
                names=["block_id", "ids", "lengths", "payload", "carried", "n_bytes"],
            )
            held, size, seq = [], 0, seq + 1
            return row

        for batch in batches:
            for part in T.slices(batch, "text", BLOCK_BYTES):
                raw, off, nulls = T.buffers(part.column("text"))
                if held and size + len(raw) > BLOCK_BYTES:
                    yield flush()
                held.append((part.column("id"), np.where(nulls, -1, np.diff(off)), raw.tobytes(), part.select(other)))
                size += len(raw)
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, other, strict=True)])
    return cut(rows.mapInArrow(packed, BLOCK_SCHEMA))


def n_buckets(blocks: DataFrame) -> int:
    """Buckets in proportion to the text: about as many as blocks, three for each shuffle partition at least."""
    n = blocks.count()
    return max(3 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n)


def split_sorted(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted uint64 keys for n buckets by their leading bits, without empty ones: the work is that of the keys, however many buckets there are."""
    if not len(keys):
        return
    bucket = keys // np.uint64((1 << 64) // n + 1) if n > 1 else np.zeros(len(keys), np.uint64)
    head = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(keys)], strict=True):
        yield int(bucket[lo]), slice(lo, hi)


def from_blocks(blocks: DataFrame, make: Callable[[Block], Iterator[dict]], schema: str, **options) -> DataFrame:
    """Rows that ``make`` yields for each block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from as_batches(make(Block(row, **options)), schema)

    return blocks.mapInArrow(run, schema)


def as_batches(rows: Iterator[dict], schema: str, most: int = 512) -> Iterator[pa.RecordBatch]:
    want = arrow_schema(schema)
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, want)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, want)


_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, pa.list_(_KINDS[kind[6:-1]]) if kind.startswith("array<") else _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def by_bucket(requests: DataFrame, answer: Callable[[dict[str, list]], Iterator[dict]], schema: str, keys: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """``answer`` gets the columns of all requests to a bucket and yields rows."""
    want = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(list(answer(table.to_pydict())), want)
        release()
        return out

    return requests.groupBy(*keys).applyInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, make: Callable[[Block, list[dict]], pa.Table], schema: str | T_.StructType, **options) -> DataFrame:
    """``make`` gets each block with the answers to it, and returns a table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return (arrow_schema(schema) if isinstance(schema, str) else to_arrow_schema(schema)).empty_table()
        out = make(Block(rows[0], **options), right.to_pylist())
        release()
        return out

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(run, schema)

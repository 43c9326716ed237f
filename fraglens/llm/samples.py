"""Bounded samples of labelled rows, the same whatever the partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

#: Labels that a model can be fitted on; more are an error, none is left out.
MOST_LABELS = 4096


def out_of_fold(id_col: str, modulus: int, rest: int) -> Column:
    """Rows that may be learned from: crc32 of the id as text does not leave ``rest``; null ids are never learned."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != rest


def spread(raw: bytes, size: int, most: int) -> bytes:
    """All of a text, or ``most`` pieces of ``size`` bytes at even distances over the whole of it."""
    n = -(-len(raw) // size)
    if n <= most:
        return raw
    return b"".join(raw[k * size : (k + 1) * size] for k in np.linspace(0, n - 1, most).astype(int).tolist())


def pieces(rows: DataFrame, size: int, most: int, text: str = "text") -> DataFrame:
    """The rows with the text as such bytes, cut in the executors."""
    schema = rows.drop(text).schema.add("raw", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text, 1 << 22):
                rest = part.drop_columns([text])
                raw = [spread(t.encode("utf-8", "replace"), size, most) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(raw, pa.binary())], names=[*rest.schema.names, "raw"])

    return rows.mapInArrow(run, schema)


def least_hashes(rows: DataFrame, label: str, most: int) -> DataFrame:
    """(label, h): the ``most`` least hashes of each label. A task keeps as many of each label at a time, and only these are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            names, number = np.unique(np.array(batch.column(label).to_pylist(), object), return_inverse=True)
            h = np.asarray(batch.column("h"))
            for k, name in enumerate(names.tolist()):
                kept[name] = np.unique(np.append(kept.get(name, h[:0]), h[number == k]))[:most]
        for name, h in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h, pa.int64())], names=[label, "h"])

    few = rows.select(label, "h").mapInArrow(run, f"{label} string, h long").distinct()
    # In buckets of the hash first, so that the last task of a label gets a few times ``most`` rows, however many tasks gave some.
    for buckets in (64, 8, 1):
        rank = F.row_number().over(Window.partitionBy(label, F.pmod("h", F.lit(buckets))).orderBy("h"))
        few = few.withColumn("r", rank).filter(F.col("r") <= most).drop("r")
    return few


def per_class(rows: DataFrame, label: str, most: int, size: int, n_pieces: int) -> list[tuple[str, bytes]]:
    """At most ``most`` (label, bytes) rows of each label, those with the least hash of id and text, in the order of both.

    ``rows`` has id, text and the label. Two passes over them, whatever the number of labels: hashes are ranked, then the
    chosen texts are cut to ``n_pieces`` pieces of ``size`` bytes where they stand.
    """
    hashed = rows.withColumn("h", F.xxhash64("id", "text"))
    chosen = least_hashes(hashed, label, most).collect()
    labels = {r[0] for r in chosen}
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{len(labels)} labels; at most {MOST_LABELS} can be learned")
    if not chosen:
        return []
    # At most ``most`` rows of 16 bytes for each label.
    wanted = F.broadcast(rows.sparkSession.createDataFrame(chosen, f"{label} string, h long"))
    found = pieces(hashed.join(wanted, [label, "h"], "left_semi").select(label, "h", "text"), size, n_pieces)
    return [(r[0], bytes(r.raw)) for r in sorted(found.dropDuplicates([label, "h"]).collect(), key=lambda r: (r[0], r.h))]

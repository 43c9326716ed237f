"""A quality classifier by compression with two dictionaries.

Two zstandard dictionaries are built from a bounded sample of good and of bad
labelled texts (``sample`` documents of each, and of a longer text ``TEXT_PIECES``
pieces at even distances: documented parameters; half of each builds the
dictionary, the other half calibrates). A document is cut into pieces
of ``piece`` bytes, all of which are compressed with either dictionary. The
difference of the total sizes by their sum is the document's margin; a logistic
curve, fitted on the calibration half with the classes weighted as they occur
among the labels, turns it into the probability of label 1.

Special cases: null and empty texts have margin zero and the score of that;
without labels of both classes the score is the share of label 1, or 0.5 with
none; labels other than 0 and 1 are left out, a document with both is learned
with both; texts of any length are scored whole; a score of exactly 0.5 predicts
1; rows of equal id are learned once, by the least text, and get a row each; a null
id is held out; an empty table gives an empty result; extra columns, whatever
their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples
from . import text as T
from .blocks import lean

SAMPLE = 1500
PIECE = 256
TEXT_PIECES = 64
DICTIONARY = 112_640
LEVEL = 3


def pieces(raw: bytes, size: int = PIECE) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Margin:
    """Compressed sizes with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.with_ = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.with_.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, raw: bytes) -> float:
        good, bad = self.with_
        parts = pieces(raw)
        g, b = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
        return (b - g) / (b + g) if parts else 0.0


def dictionary(texts: list[bytes]) -> bytes:
    parts = [p for t in texts for p in pieces(t)]
    size = min(DICTIONARY, max(256, sum(map(len, parts)) // 8))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[:DICTIONARY] or b"\0" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton's method with a little shrinkage."""
    scale = float(np.std(x)) or 1.0
    a = np.stack((x / scale, np.ones(len(x))), 1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * beta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(rows: list[tuple[int, bytes]], counts: dict[int, int]) -> tuple[bytes, bytes, float, float] | float:
    """Dictionaries, slope and offset; or a constant score."""
    by = {c: [t for q, t in rows if q == c] for c in (0, 1)}
    if min(map(len, by.values())) < 2:
        total = sum(counts.values())
        return counts.get(1, 0) / total if total else 0.5
    good, bad = (dictionary(by[c][::2]) for c in (1, 0))
    margin = Margin(good, bad)
    x = np.array([margin(t) for c in (0, 1) for t in by[c][1::2]])
    y = np.repeat([0.0, 1.0], [len(by[0][1::2]), len(by[1][1::2])])
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) / sum(counts.values()) * len(y)
    return good, bad, *logistic(x, y, weight)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, rest: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from labelled rows outside the fold."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & samples.out_of_fold("id", modulus, rest))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    # The chosen ids are at most 2 * sample; they find their texts by a small broadcast.
    chosen = [(v, i) for v in (0, 1) for (i,) in marked.filter(F.col("y") == v).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(chosen, "y int, id long") if chosen else spark.createDataFrame([], "y int, id long")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    found = samples.pieces(texts.join(F.broadcast(wanted), "id"), PIECE, TEXT_PIECES).groupBy("y", "id").agg(F.min("raw").alias("raw")).collect()
    found.sort(key=lambda r: (r["y"], r["id"]))
    shared = spark.sparkContext.broadcast(fit([(r["y"], bytes(r.raw)) for r in found], counts))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        margin = None if isinstance(model, float) else Margin(model[0], model[1])
        for batch in batches:
            raw, off, _ = T.buffers(batch.column("text"))
            view = raw.tobytes()
            if margin is None:
                score = np.full(batch.num_rows, model)
            else:
                x = np.array([margin(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                score = 1 / (1 + np.exp(-np.clip(model[2] * x + model[3], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", F.coalesce(~samples.out_of_fold("doc_id", modulus, rest), F.lit(True)).alias("held_out"), "score", "predicted")

"""Streams: alignments to whole molecules, scored when they are closed; events to windows and sessions; counters by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import cut
from ..sources.annotation import ALIGNMENT_SCHEMA


def read_alignments(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of alignment rows, some for each micro-batch."""
    return spark.readStream.schema(ALIGNMENT_SCHEMA + ", seen timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def molecules(alignments: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(qname, session, n_records, n_hits, multimapping): records of a molecule may come in several batches.

    A molecule is a session of its name: it is closed, written once and forgotten when the watermark passes ``delay``
    after its last record; later records go. ``OpenMolecules`` keeps these, and hands out whole records.
    """
    kept = alignments.filter(F.col("flag").bitwiseAND(F.lit(0x4 | 0x200 | 0x400)) == 0).withWatermark("seen", delay)
    hits = F.size(F.collect_set(F.greatest("hi", F.lit(0))))
    return kept.groupBy(F.session_window("seen", delay).alias("session"), "qname").agg(
        F.count("*").alias("n_records"), hits.alias("n_hits"), F.max((F.col("nh") > 1) | (F.col("flag").bitwiseAND(F.lit(0x100)) != 0)).alias("multimapping"))


def windowed(events: DataFrame, at: str, by: list[str], width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(by, lo, hi, n, total) over tumbling or sliding windows; the same on a stream (with watermark) and a table."""
    e = events.withWatermark(at, delay) if events.isStreaming else events
    w = F.window(at, width, slide) if slide else F.window(at, width)
    got = e.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(*by, F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), "n", "total")


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``sink`` on every micro-batch until the input is used up."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OpenMolecules:
    """A sink for ``each_batch`` that hands out the records of whole molecules, whatever batches they come in.

    Records of open molecules are a table in ``folder``, one version for each batch. After a batch, a molecule is closed
    if its last record is older than the newest one seen so far by more than ``delay`` seconds: its records go through
    ``score``, whose rows are written to ``closed``. A record that is older than that when it comes, and whose molecule
    is not open, is late: it is written to ``late`` as it is, and counted. All that a batch writes is under its number and
    overwritten if the batch runs again, so that a restart after a lost driver repeats nothing. What is kept is bounded
    by the molecules that are open; the records of a molecule meet by its name only.
    """

    def __init__(self, spark: SparkSession, folder: str, delay: float, score: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.delay, self.score = spark, folder, delay, score or (lambda rows: rows)

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _forget(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _put(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def __call__(self, new: DataFrame, batch: int) -> None:
        before, mark = f"{self.folder}/open/batch={batch - 1}", None
        held = new.limit(0)
        if batch and self._exists(before):
            held = self.spark.read.parquet(before)
            mark = self.spark.read.parquet(f"{self.folder}/mark/batch={batch - 1}").first().mark
        new = cut(new)
        late = new.limit(0)
        if mark is not None:
            late = new.filter(F.unix_micros("seen") / 1e6 < mark).join(held.select("qname").distinct(), "qname", "left_anti").select(*new.columns)
        self._put(late, "late", batch)
        rows = held.unionByName(new)
        if mark is not None:
            old = F.unix_micros("seen") / 1e6 < mark
            rows = held.unionByName(new.filter(~old)).unionByName(new.filter(old).join(held.select("qname").distinct(), "qname", "left_semi").select(*new.columns))
        newest = new.agg(F.max(F.unix_micros("seen") / 1e6)).first()[0]
        known = [x for x in (mark, None if newest is None else newest - self.delay) if x is not None]
        now = max(known) if known else None
        self._put(self.spark.createDataFrame([(now,)], "mark double"), "mark", batch)
        rows = cut(rows)
        done = rows.groupBy("qname").agg(F.max(F.unix_micros("seen") / 1e6).alias("last")).filter(F.lit(False) if now is None else F.col("last") < now).select("qname")
        self._put(self.score(rows.join(done, "qname", "left_semi").select(*new.columns)), "closed", batch)
        self._put(rows.join(done, "qname", "left_anti").select(*new.columns), "open", batch)
        for kind in ("open", "mark"):
            self._forget(f"{self.folder}/{kind}/batch={batch - 2}")

    def _last(self) -> int | None:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/open")
        system = fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [e.getPath().getName() for e in system.listStatus(fs)] if system.exists(fs) else []
        return max((int(n.split("=")[1]) for n in names if n.startswith("batch=")), default=None)

    def finish(self) -> None:
        """Closes what is open, at the end of the input."""
        last = self._last()
        if last is not None:
            self._put(self.score(self.spark.read.parquet(f"{self.folder}/open/batch={last}")), "closed", last + 1)
            self._forget(f"{self.folder}/open/batch={last}")

    def closed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/closed").drop("batch")

    def late(self) -> DataFrame:
        """Late records, by the batch in which they came."""
        return self.spark.read.parquet(f"{self.folder}/late")

"""The index as a folder of tables with a manifest, written once and checked whenever it is read."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotation as A
from . import sinks

VERSION = 1


@dataclass
class Index:
    transcripts: DataFrame
    intervals: DataFrame | None
    junctions: DataFrame | None
    blacklist: DataFrame | None
    manifest: dict | None


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def flat(df: DataFrame) -> DataFrame:
    """Lists and records as JSON, so that text can hold them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_text(spark: SparkSession, value: dict, path: str) -> None:
    """A JSON object as a text of one line."""
    spark.createDataFrame([(json.dumps(value, default=str, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_index(transcripts: DataFrame, path: str, lengths: DataFrame | None = None, blacklist: DataFrame | None = None, tsv: bool = False) -> dict:
    """Writes transcripts, intervals (with what lies between transcripts, where lengths are given), junctions, genes and the blacklist, mirrors of them as text if asked, and the manifest last; returns the manifest."""
    spark = transcripts.sparkSession
    sinks.write_table(transcripts, f"{path}/transcripts")
    t = spark.read.parquet(f"{path}/transcripts")
    real = t.filter("NOT is_synthetic")
    intervals = A.transcript_intervals(real)
    if lengths is not None:
        between = A.intergenic(real, lengths).select("ref", "start", "end", F.lit(0).alias("strand"), F.lit(A.INTERGENIC).alias("interval_type"), F.lit(-1).alias("t_index"))
        intervals = intervals.unionByName(between)
    tables = {"intervals": intervals, "junctions": A.junctions(real), "genes": A.genes(t)} | ({"blacklist": blacklist} if blacklist is not None else {})
    for name, df in tables.items():
        sinks.write_table(df, f"{path}/{name}")
    rows = {}
    for name in ("transcripts", *tables):
        df = spark.read.parquet(f"{path}/{name}")
        rows[name] = df.count()
        if tsv:
            sinks.write_table(flat(df), f"{path}/text/{name}", "tsv")
    manifest = {"version": VERSION, "rows": rows}
    write_text(spark, manifest, f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """None for a folder without one."""
    return read_text(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest") else None


def read_index(spark: SparkSession, path: str) -> Index:
    """The tables of a folder; an error where the manifest is of another version or tells other numbers of rows, or transcripts are not numbered from 0 without gaps."""
    manifest = read_manifest(spark, path)
    if manifest is not None and manifest["version"] != VERSION:
        raise ValueError(f"index of version {manifest['version']}, not {VERSION}")
    has = (manifest or {}).get("rows", {})
    transcripts = spark.read.parquet(f"{path}/transcripts")
    seen = transcripts.agg(F.count("*").alias("n"), F.min("t_index").alias("low"), F.max("t_index").alias("high"), F.count_distinct("t_index").alias("distinct")).first()
    if seen.n and (seen.low, seen.high, seen.distinct) != (0, seen.n - 1, seen.n):
        raise ValueError("transcripts are not numbered from 0 without gaps")
    if has.get("transcripts", seen.n) != seen.n:
        raise ValueError(f"the index has {seen.n} transcripts, its manifest {has['transcripts']}")
    table = lambda name: spark.read.parquet(f"{path}/{name}") if name in has else None
    return Index(transcripts, table("intervals"), table("junctions"), table("blacklist"), manifest)

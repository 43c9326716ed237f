"""Grids of settings and their runs, groups of transcripts, and how a number of fragments is split over pools."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import intervals as I
from .common import cut


def values(spec: Any) -> list:
    """A list as it is, a mapping start, stop, step (stop included) as its numbers, anything else as the one value."""
    if isinstance(spec, dict):
        start, stop, step = spec["start"], spec["stop"], spec.get("step", 1)
        if step <= 0:
            raise ValueError("a range needs a step above 0")
        return [start + k * step for k in range(math.floor((stop - start) / step + 1e-9) + 1)]
    return list(spec) if isinstance(spec, (list, tuple)) else [spec]


def grid(spark: SparkSession, specs: dict[str, Any]) -> DataFrame:
    """A row for every combination of the settings' values, a column for each setting."""
    out = spark.range(1).select()
    for name, spec in specs.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values(spec)))).alias(name))
    return out


def two_pools(first: Column, whole: Column, total: int) -> tuple[Column, Column]:
    """Aggregates: a whole number of ``total`` for the first of two pools by its share of the weight, the rest for the second; nothing weighs nothing."""
    n = F.round(F.coalesce(F.sum(first) / F.nullif(F.sum(whole), F.lit(0.0)), F.lit(0.0)) * total).cast("long")
    return n, F.lit(total) - n


def normalised(df: DataFrame, weight: Column, name: str) -> DataFrame:
    """Adds the weight as a share of all rows' weights; equal shares where all are zero."""
    one = df.withColumn("_w", weight.cast("double"))
    total = one.agg(F.sum("_w").alias("_t"), F.count("*").alias("_n"))
    out = one.crossJoin(F.broadcast(total))  # one row
    return out.withColumn(name, F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(1 / F.col("_n"))).drop("_w", "_t", "_n")


def carriers(df: DataFrame, by: list[str], prefer: Column, score: Column, tie: str) -> DataFrame:
    """(by, carrier): in each group the row that is preferred, then of the highest score, then of the least ``tie``."""
    return df.groupBy(*by).agg(F.max_by(tie, F.struct(prefer.alias("a"), score.alias("b"), (-F.col(tie)).alias("c"))).alias("carrier"))


def nascent_groups(transcripts: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(label, members, ref, strand, start, end, carrier): transcripts that share a nascent molecule.

    ``given`` groups (label, t_id) come first; one with an unknown transcript, or with several strands or references, is an
    error. All other transcripts are grouped where their spans overlap on one strand, under the name of the first; where
    a given group has that name, of its strand and place. The carrier is the longest transcript of several exons, or else
    the longest of all, the first of equal ones.
    """
    spans = transcripts.select("t_id", "ref", "strand", "start", "end", (F.size("exons") > 1).alias("multi"))
    taken = given if given is not None else spans.select(F.lit(None).cast("string").alias("label"), "t_id").limit(0)
    named = taken.join(spans, "t_id", "left")
    own = named.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "t_id"))).alias("ms"), F.min("ref").alias("ref"), F.min("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.count_if(F.col("ref").isNull()).alias("lost"), F.max_by("t_id", F.col("ref").isNull()).alias("one"), F.count_distinct("strand").alias("k"), F.count_distinct("ref").alias("r"))
    wrong = F.when(F.col("lost") > 0, F.concat(F.lit("unknown transcript in a group: "), "one")).when((F.col("k") > 1) | (F.col("r") > 1), F.concat(F.lit("transcripts on different strands or references: "), "label"))
    own = own.select(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("label")).alias("label"), F.transform("ms", lambda m: m.t_id).alias("members"), "ref", "strand", "start", "end")
    rest = spans.join(taken.select("t_id"), "t_id", "left_anti")
    made = I.overlap_groups(rest, ["ref", "strand"], "start", "end", "t_id").withColumn("first", F.concat(F.lit("nrna_"), F.col("members")[0]))
    used = taken.select(F.col("label").alias("first"), F.lit(True).alias("used")).distinct()
    placed = F.concat_ws("_", F.lit("nrna"), "strand", "start", "end")
    made = made.join(used, "first", "left").select(F.when(F.col("used"), placed).otherwise(F.col("first")).alias("label"), "members", "ref", "strand", "start", "end")
    groups = own.unionByName(made)
    each = groups.select("label", F.explode("members").alias("t_id")).join(spans, "t_id")
    carrier = each.groupBy("label").agg(F.min_by("t_id", F.struct(~F.col("multi"), F.col("start") - F.col("end"), "start", "t_id")).alias("carrier"))
    return groups.join(carrier, "label")


# -- runs -------------------------------------------------------------------


def points(specs: dict[str, Any]) -> list[dict[str, Any]]:
    """All combinations of the settings' values, the last setting changing first."""
    out: list[dict[str, Any]] = [{}]
    for name, spec in specs.items():
        out = [p | {name: v} for p in out for v in values(spec)]
    return out


def point_name(point: dict[str, Any]) -> str:
    """The same for the same settings, in whatever order."""
    return hashlib.sha256(json.dumps(point, sort_keys=True).encode()).hexdigest()[:16]


def simulated_point(transcripts: DataFrame, references: DataFrame, point: dict[str, Any]) -> DataFrame:
    """(pool, t_id, expected, observed) of a simulation with the settings and the run over it; genomic fragments have no transcript, nascent ones that of their pool as a whole.

    Settings: mrna, nrna and gdna (fragments), those of the simulation, those of the run by their names on the command
    line, and ``abundance_`` or ``nascent_`` with the name of a transcript; others are an error.
    """
    from .. import quantify as Q
    from ..config import FLAGS, resolve
    from . import simulate as M

    own = {f.name for f in dataclasses.fields(M.SimConfig)}
    sizes = {k: int(point.get(k, 0)) for k in ("mrna", "nrna", "gdna")}
    unknown = [k for k in point if k not in own and k not in FLAGS and k not in sizes and not k.startswith(("abundance_", "nascent_"))]
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    config, _ = resolve({k: v for k, v in point.items() if k in FLAGS})
    sim = M.SimConfig(**{k: v for k, v in point.items() if k in own})

    def told(prefix: str, default: Column) -> Column:
        given = [F.when(F.col("t_id") == k.removeprefix(prefix), float(v)) for k, v in point.items() if k.startswith(prefix)]
        return F.coalesce(*given, default)

    t = transcripts.withColumn("abundance", told("abundance_", F.lit(1.0)))
    t = t.withColumn("nrna_abundance", told("nascent_", F.when(F.size("exons") > 1, F.col("abundance")).otherwise(0.0)))
    rows = cut(M.paired_records(M.fragments(t, references, *sizes.values(), sim), sim.read_length))
    got = Q.quantify(rows, transcripts, config)
    truth = M.truth(rows)
    seen = got.tables["quant"].select(F.lit("mrna").alias("pool"), F.col("transcript_id").alias("t_id"), F.col("count").alias("observed"))
    mature = seen.join(truth.filter("pool = 'mrna'").select("t_id", F.col("n").cast("double").alias("expected")), "t_id", "left").select("pool", "t_id", F.coalesce("expected", F.lit(0.0)).alias("expected"), "observed")
    n = {r.pool: r.n for r in truth.groupBy("pool").agg(F.sum("n").alias("n")).collect()}
    totals = got.summary["totals"]
    whole = [("nrna", None, float(n.get("nrna", 0)), float(totals["nrna"])), ("gdna", None, float(n.get("gdna", 0)), float(totals["gdna"]))]
    return mature.unionByName(rows.sparkSession.createDataFrame(whole, "pool string, t_id string, expected double, observed double"))


def sweep(spark: SparkSession, specs: dict[str, Any], folder: str, run: Callable[[dict[str, Any]], DataFrame]) -> tuple[int, int]:
    """Runs every point of the grid that has no finished results in ``folder``; (points run, points that were there).

    A point's rows are one folder, named by its settings; one that broke off has no mark of success and is run again.
    """
    jvm, done, there = spark.sparkContext._jvm, 0, 0
    for point in points(specs):
        path = f"{folder}/point={point_name(point)}"
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            there += 1
            continue
        difference = F.abs(F.col("observed") - F.col("expected"))
        relative = F.when(F.col("expected") > 0, difference / F.col("expected")).when(F.col("observed") == 0, 0.0)
        got = run(point).withColumns({"settings": F.lit(json.dumps(point, sort_keys=True)), "abs_diff": difference, "rel_err": relative})
        got.write.mode("overwrite").parquet(path)
        done += 1
    return done, there


def sweep_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all points, with their settings as a map of text and the point's name."""
    return spark.read.parquet(folder).withColumn("settings", F.from_json("settings", "map<string,string>"))


def sweep_summary(results: DataFrame) -> DataFrame:
    """(point, settings, pool, expected, observed, abs_diff, rel_err, worst): totals of each pool, and the largest relative error of a transcript."""
    per = results.groupBy("point", "pool").agg(F.first("settings").alias("settings"), F.sum("expected").alias("expected"), F.sum("observed").alias("observed"), F.max("rel_err").alias("worst"))
    off = F.abs(F.col("observed") - F.col("expected"))
    return per.select("point", "settings", "pool", "expected", "observed", off.alias("abs_diff"), F.when(F.col("expected") > 0, off / F.col("expected")).alias("rel_err"), "worst")

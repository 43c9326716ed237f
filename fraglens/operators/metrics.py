"""Accuracy of predictions against truth."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sum


def average_rank(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds the average rank; values are counted first, so that only distinct ones are ranked."""
    per = df.groupBy(x).agg(F.count("*").alias("_n"))
    # A running sum in two levels: within ranges of equal log size, then over the ranges.
    bucket = per.withColumn("_b", F.when(F.col(x) > 0, F.floor(F.log2(F.when(F.col(x) > 0, F.col(x))) * 64)).otherwise(F.lit(-100000)))
    before = bucket.groupBy("_b").agg(F.sum("_n").alias("_m")).withColumn("_o", F.coalesce(F.sum("_m").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    w = Window.partitionBy("_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bucket.join(before, "_b").select(x, (F.col("_o") + F.sum("_n").over(w) - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranked, x, "left")


def median(df: DataFrame, by: list[str], x: str, name: str = "median") -> DataFrame:
    """(by, name): the exact median. Values are counted, the counts summed in ranges of the value; no task holds a group."""
    one = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    per = rows.filter(F.col(x).isNotNull()).groupBy(*one, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    up_to = running_sum(per, [*one, "_x"], "_n", "_c")
    bounds = up_to.groupBy(*one).agg((F.min("_c") - F.min_by("_n", "_c")).alias("_before"), F.max("_c").alias("_last"))
    placed = up_to.join(bounds, one).withColumns({"_hi": F.col("_c") - F.col("_before"), "_t": F.col("_last") - F.col("_before")}).withColumn("_lo", F.col("_hi") - F.col("_n"))
    at = lambda k: F.max(F.when((F.col("_lo") < k) & (F.col("_hi") >= k), F.col("_x")))
    lower, upper = F.floor((F.col("_t") + 1) / 2), F.floor(F.col("_t") / 2) + 1
    return placed.groupBy(*one).agg(((at(lower) + at(upper)) / 2).alias(name)).select(*by, name)


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    ranked = average_rank(average_rank(df, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def accuracy(df: DataFrame, truth: str, pred: str, threshold: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """(by, metrics): errors with their median, correlations, and the confusion of what is above the threshold."""
    by = by or []
    rows = df.withColumn("_e", F.abs(F.col(pred) - F.col(truth)))
    most = rows.groupBy(*by).agg(*overall(F.col(truth), F.col(pred), threshold))
    mid = median(rows, by, "_e", "median_ae")
    if not by:
        return most.crossJoin(F.broadcast(mid))  # one row each
    names = [f"_k{i}" for i in range(len(by))]
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(by, names, strict=True)]
    return most.join(mid.withColumnsRenamed(dict(zip(by, names, strict=True))), reduce(and_, on), "left").drop(*names)


def overall(truth: Column, pred: Column, threshold: float = 0.0) -> list[Column]:
    """Aggregates over rows: errors, correlations, and the confusion of what is above the threshold."""
    err = pred - truth
    t, p = truth > threshold, pred > threshold
    tp, fp, fn = F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p)
    precision, recall = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    log = lambda x: F.log2(x + 1)
    return [
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.when(truth > 0, F.abs(err) / truth) * 100).alias("mape"), (F.sum(F.when(truth > 0, F.abs(err)).otherwise(0.0)) / F.nullif(F.sum(truth), F.lit(0.0))).alias("ware"),
        F.corr(truth, pred).alias("pearson"), F.corr(log(truth), log(pred)).alias("log2_pearson"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"),
    ]


def expression_bin(x: Column) -> Column:
    """Zero, decades from 1 on; values between 0 and 1 have none."""
    return F.when(x == 0, "zero").when((x >= 1) & (x < 10), "1-10").when((x >= 10) & (x < 100), "10-100").when((x >= 100) & (x < 1000), "100-1000").when(x >= 1000, "1000+")


def top_outliers(df: DataFrame, a: str, b: str, key: str, least: float, n: int) -> DataFrame:
    """The n rows of greatest |log2((b + 1) / (a + 1))| among those with a + b at least ``least``; the feature is the limit."""
    change = F.round(F.log2((F.col(b) + 1) / (F.col(a) + 1)), 6)
    return df.filter(F.col(a) + F.col(b) >= least).withColumn("log2_change", change).orderBy(F.abs("log2_change").desc(), key).limit(n)


def pairwise(df: DataFrame, a: str, b: str, threshold: float = 0.0) -> DataFrame:
    """(pearson, both, only_a, only_b): agreement of two predictions on what is above the threshold."""
    x, y = F.col(a) > threshold, F.col(b) > threshold
    return df.agg(F.corr(a, b).alias("pearson"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"))


def pool_metrics(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """(by, truth, pred, error, rel_error): sums over a pool; the relative error is null where there is no truth."""
    t, p = F.sum(truth), F.sum(pred)
    return df.groupBy(*by).agg(t.alias("truth"), p.alias("pred"), (p - t).alias("error"), ((p - t) / F.nullif(t, F.lit(0.0))).alias("rel_error"))


def expected_observed(df: DataFrame, key: list[str], side: str, expected: str, observed: str, value: str) -> DataFrame:
    """(key, expected, observed, exact, rel_error): two kinds of rows side by side, 0 where one has none, in one pass."""
    of = lambda v: F.sum(F.when(F.col(side) == v, F.col(value)))
    g = df.filter(F.col(side).isin(expected, observed)).groupBy(*key).agg(of(expected).alias("_e"), of(observed).alias("_o"))
    e, o = F.coalesce("_e", F.lit(0.0)), F.coalesce("_o", F.lit(0.0))
    return g.select(*key, e.alias("expected"), o.alias("observed"), (e == o).alias("exact"), (F.abs(o - F.col("_e")) / F.nullif(F.col("_e"), F.lit(0.0))).alias("rel_error"))


def summary(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, n, mean, std, median): std of the population, the exact median."""
    most = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return most.join(median(df, by, x), by)


def contamination(df: DataFrame, by: list[str], genomic: Column, weight: str) -> DataFrame:
    """(by, rate): the genomic part of the weight, 0 where there is none."""
    t = F.sum(weight)
    return df.groupBy(*by).agg(F.when(F.coalesce(t, F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce(F.sum(F.when(genomic, F.col(weight))), F.lit(0.0)) / t).alias("rate"))


def with_truth(truth: DataFrame, predicted: DataFrame, key: str, value: str) -> DataFrame:
    """The truth's rows with the prediction, 0 where it has none."""
    return truth.join(predicted.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0).cast(predicted.schema[value].dataType)))


def three_way(left: DataFrame, middle: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows whose key all three have."""
    return left.join(middle, key).join(right, key)


def per_transcript(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows with any truth or prediction, the truth scaled to a million: truth_tpm, residual, abs_error, rel_error (null without truth)."""
    total = df.agg(F.sum(truth).alias("_t"))
    scaled = df.crossJoin(F.broadcast(total)).withColumn("truth_tpm", F.when(F.col("_t") > 0, F.col(truth) / F.col("_t") * 1e6).otherwise(F.col(truth))).drop("_t")  # one row
    kept = scaled.filter((F.col("truth_tpm") > 0) | (F.col(pred) > 0)).withColumn("residual", F.col(pred) - F.col("truth_tpm")).withColumn("abs_error", F.abs("residual"))
    return kept.withColumn("rel_error", F.when(F.col("truth_tpm") > 0, F.col("abs_error") / F.col("truth_tpm")))

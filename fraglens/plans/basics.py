"""Histograms, roll-ups, metrics and scalar expressions over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import histograms as H
from ..operators import metrics as M
from ..operators import rollup as R
from ..operators import sweeps as W
from ..operators import training as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its own name, with the SQL that gives the same rows."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def r6(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


QTY = "SELECT CAST(l_quantity AS BIGINT) AS k, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1"
DENSE = f"SELECT k, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 51)) AS k) LEFT JOIN ({QTY}) USING (k)"


@query(DENSE)
def hist_dense(spark, d):
    return H.dense(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 50)


@query("SELECT l_returnflag AS category, CAST(l_quantity AS BIGINT) AS k, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS is_total FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY GROUPING SETS ((CAST(l_quantity AS BIGINT)), (l_returnflag, CAST(l_quantity AS BIGINT)))")
def hist_grouping_sets(spark, d):
    return H.with_total(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", 50)


@query("""WITH h AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS k, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY k) AS c, sum(n) OVER (PARTITION BY l_returnflag) AS t FROM h)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS total, round(sum(k * n) / sum(n), 6) AS mean, round(sqrt(sum(k * k * n) / sum(n) - power(sum(k * n) / sum(n), 2)), 6) AS std,
min(k) FILTER (2 * c >= t) AS median, arg_max(k, n * 1000 - k) AS mode FROM c GROUP BY 1""")
def hist_moments(spark, d):
    h = H.dense(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", 50, ["l_returnflag"])
    return H.moments(h, ["l_returnflag"]).select("l_returnflag", "total", r6("mean", "mean"), r6("std", "std"), "median", "mode")


DIRICHLET = f"""WITH prior AS ({DENSE}), h AS (SELECT f.l_returnflag, b.k, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT unnest(range(0, 51)) AS k) b
LEFT JOIN (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON c.l_returnflag = f.l_returnflag AND c.k = b.k),
s AS (SELECT k, n * least(1.0::DOUBLE, 500.0 / sum(n) OVER ()) AS p FROM prior),
lp AS (SELECT l_returnflag, h.k, ln((h.n + p + 1) / (sum(h.n) OVER (PARTITION BY l_returnflag) + sum(p) OVER (PARTITION BY l_returnflag) + 51)) AS log_p FROM h JOIN s USING (k))"""


def _lengths(spark, d) -> dict:
    """Length models by flag, with all rows as prior: histograms of 51 bins."""
    rows = H.dense(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", 50, ["l_returnflag"]).collect()
    every = T.array_of(rows, 50)
    return {f: T.LengthModel(T.array_of([r for r in rows if r.l_returnflag == f], 50), every, 500.0) for f in {r.l_returnflag for r in rows}}


@query(DIRICHLET + " SELECT l_returnflag, k, round(log_p, 6) AS log_p FROM lp")
def dirichlet_log_prob(spark, d):
    rows = [(f, k, round(float(x), 6)) for f, m in _lengths(spark, d).items() for k, x in enumerate(m.log_table())]
    return spark.createDataFrame(rows, "l_returnflag string, k long, log_p double")


@query(DIRICHLET + ", p AS (SELECT p_partkey, p_size * 2 AS len FROM part) SELECT p_partkey, round(CASE WHEN len <= 0 THEN 0 ELSE log_p + greatest(len - 50, 0) * ln(0.99) END, 6) AS log_lik FROM p JOIN lp ON lp.k = least(len, 50) AND l_returnflag = 'A'")
def tail_decay(spark, d):
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2).alias("len"))
    return parts.select("p_partkey", r6(_lengths(spark, d)["A"].log_lik(F.col("len")), "log_lik"))


@query(f"""WITH h AS ({DENSE}), p AS (SELECT k, n / sum(n) OVER () AS p FROM h), c AS (SELECT k, p, sum(p) OVER (ORDER BY k) AS cdf, sum(k * p) OVER (ORDER BY k) AS cmom FROM p)
SELECT p_partkey, round(greatest((p_size + 1) * (cdf - (SELECT p FROM c WHERE k = 0)) - cmom, 1), 6) AS eff_len FROM part JOIN c ON c.k = least(p_size, 50)""")
def ecdf_eff_len(spark, d):
    h = T.LengthModel(T.array_of(H.dense(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 50).collect(), 50))
    return table(spark, d, "part").select("p_partkey", r6(h.effective_length(F.col("p_size")), "eff_len"))


PARTS = "SELECT p_partkey, p_brand, p_size, coalesce(sum(l_quantity), 0) AS c FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3"


def _parts(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("c"))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size").join(sums, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_brand", "p_size", F.coalesce("c", F.lit(0.0)).alias("c"))


@query(f"WITH p AS ({PARTS}), r AS (SELECT *, c / greatest(p_size, 1) AS rate FROM p) SELECT p_partkey, round(rate / sum(rate) OVER () * 1e6, 6) AS tpm FROM r")
def tpm(spark, d):
    return R.tpm(_parts(spark, d), "c", "p_size").select("p_partkey", r6("tpm", "tpm"))


@query(f"WITH p AS ({PARTS}), r AS (SELECT *, c / greatest(p_size, 1) AS rate FROM p) SELECT p_partkey, round(rate / (SELECT sum(rate) FROM r WHERE p_size > 10) * 1e6, 6) AS tpm FROM r")
def tpm_alt_denominator(spark, d):
    return R.tpm(_parts(spark, d), "c", "p_size", F.col("p_size") > 10).select("p_partkey", r6("tpm", "tpm"))


@query(f"SELECT p_brand, count(*) AS n, round(sum(c), 6) AS count, round(coalesce(sum(c * p_size) / nullif(sum(c), 0), avg(p_size)), 6) AS mean_length FROM ({PARTS}) GROUP BY 1")
def gene_rollup(spark, d):
    return R.weighted_rollup(_parts(spark, d), ["p_brand"], "c", "p_size").select("p_brand", "n", r6("count", "count"), r6("mean_length", "mean_length"))


@query("SELECT c_mktsegment, c_nationkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def argmax_locus(spark, d):
    return R.arg_best(table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey", "c_acctbal", "c_custkey")


@query("SELECT n_regionkey, count(*) AS n_children, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation WHERE n_regionkey <> n_nationkey GROUP BY 1")
def children_counts(spark, d):
    return R.children_counts(table(spark, d, "nation"), "n_nationkey", "n_regionkey", "n_nationkey")


@query("WITH a AS (SELECT l_returnflag, sum(l_quantity) AS quantity, round(sum(l_discount), 4) AS discount FROM lineitem GROUP BY 1) SELECT l_returnflag, 'quantity' AS source, quantity AS count FROM a WHERE quantity <> 0 UNION ALL SELECT l_returnflag, 'discount', discount FROM a WHERE discount <> 0")
def detail_unpivot(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_discount"), 4).alias("discount"))
    return R.detail(a, ["l_returnflag"], ["quantity", "discount"])


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"n_F\", count(*) FILTER (l_linestatus = 'O') AS \"n_O\" FROM lineitem GROUP BY 1")
def contingency_2x2(spark, d):
    return R.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("WITH c AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, round(p, 6) AS p, round(greatest(p - 1.96 * sqrt(p * (1 - p) / n), 0), 6) AS low, round(least(p + 1.96 * sqrt(p * (1 - p) / n), 1), 6) AS high FROM c")
def wald_ci(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("k"), F.count("*").alias("n"))
    p, low, high = R.wald(F.col("k"), F.col("n"))
    return c.select("l_returnflag", r6(p, "p"), r6(low, "low"), r6(high, "high"))


@query("SELECT CASE WHEN value > 90 THEN 'top' WHEN event_type = 'click' THEN 'click' WHEN value < 10 THEN 'low' ELSE 'rest' END AS category, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def category_matrix(spark, d):
    c = F.when(F.col("value") > 90, "top").when(F.col("event_type") == "click", "click").when(F.col("value") < 10, "low").otherwise("rest")
    return table(spark, d, "events").groupBy(c.alias("category"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_linenumber > 4 THEN 3 WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS class FROM lineitem")
def fragment_class(spark, d):
    c = S.fragment_class(F.col("l_returnflag") == "R", F.greatest(F.col("l_linenumber") - 3, F.lit(1)), F.when(F.col("l_quantity") > 10, 2).otherwise(1), (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", c.alias("class"))


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 5 WHEN p_size > 30 THEN 25 WHEN p_size > 20 THEN 9 ELSE 3 END AS flags FROM part")
def bitflags(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.winner_flags(s > 30, s > 20, s > 45).alias("flags"))


_AREA = lambda x: f"CASE WHEN {x} <= w THEN {x} * {x} / 2 WHEN {x} <= len - w THEN w * w / 2 + w * ({x} - w) ELSE w * (len - w) - (len - {x}) * (len - {x}) / 2 END"


@query(f"WITH p AS (SELECT p_partkey, p_size * 20.0::DOUBLE AS len, p_size::DOUBLE AS s, least(p_size * 4, p_size * 20)::DOUBLE AS e, least(200.0, p_size * 10.0)::DOUBLE AS w FROM part) SELECT p_partkey, round(CASE WHEN e <= s THEN 1 ELSE w / greatest((({_AREA('e')}) - ({_AREA('s')})) / (e - s), 1) END, 6) AS weight, round(-ln(greatest(len - e + s + 1, 1)), 6) AS corrected FROM p")
def coverage_weight(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20.0).alias("len"), F.col("p_size").cast("double").alias("s"), (F.col("p_size") * 4.0).alias("e"))
    return p.select("p_partkey", r6(S.coverage_weight(F.col("s"), F.col("e"), F.col("len")), "weight"), r6(S.bias_correction(F.lit(0.0), F.col("len"), F.col("e") - F.col("s")), "corrected"))


PAIRED = "WITH t AS (SELECT l_partkey AS k, round(sum(l_quantity), 4) AS truth, round(sum(l_extendedprice) / 1000, 4) AS pred FROM lineitem GROUP BY 1)"
_METRICS = """count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(sqrt(avg((pred - truth) * (pred - truth))), 3) AS rmse, round(quantile_cont(abs(pred - truth), 0.5), 6) AS median_ae,
round(avg(abs(pred - truth) / truth * 100) FILTER (truth > 0), 5) AS mape, round(sum(abs(pred - truth)) FILTER (truth > 0) / sum(truth), 6) AS ware, round(corr(truth, pred), 6) AS pearson, round(corr(log2(truth + 1), log2(pred + 1)), 6) AS log2_pearson,
count(*) FILTER (truth > 500 AND pred > 500) AS tp, count(*) FILTER (truth <= 500 AND pred > 500) AS fp, count(*) FILTER (truth > 500 AND pred <= 500) AS fn,
round(count(*) FILTER (truth > 500 AND pred > 500) / nullif(count(*) FILTER (pred > 500), 0), 6) AS precision, round(count(*) FILTER (truth > 500 AND pred > 500) / nullif(count(*) FILTER (truth > 500), 0), 6) AS recall,
round(2.0 * count(*) FILTER (truth > 500 AND pred > 500) / nullif(2 * count(*) FILTER (truth > 500 AND pred > 500) + count(*) FILTER (truth <= 500 AND pred > 500) + count(*) FILTER (truth > 500 AND pred <= 500), 0), 6)::DOUBLE AS f1"""


def _paired(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.sum("l_quantity"), 4).alias("truth"), F.round(F.sum("l_extendedprice") / 1000, 4).alias("pred"))


def _rounded(df, keys=()):
    whole = {"n", "tp", "fp", "fn", *keys}
    return df.select(*[F.col(c) if c in whole else F.round(c, {"rmse": 3, "mape": 5}.get(c, 6)).alias(c) for c in df.columns])


@query(f"{PAIRED} SELECT {_METRICS} FROM t")
def metrics_overall(spark, d):
    return _rounded(M.accuracy(_paired(spark, d), "truth", "pred", 500.0))


@query(f"{PAIRED} SELECT CASE WHEN truth = 0 THEN 'zero' WHEN truth >= 1 AND truth < 10 THEN '1-10' WHEN truth >= 10 AND truth < 100 THEN '10-100' WHEN truth >= 100 AND truth < 1000 THEN '100-1000' WHEN truth >= 1000 THEN '1000+' END AS bin, {_METRICS} FROM t GROUP BY 1")
def metrics_stratified(spark, d):
    return _rounded(M.accuracy(_paired(spark, d).withColumn("bin", M.expression_bin(F.col("truth"))), "truth", "pred", 500.0, ["bin"]), ("bin",))


@query(f"{PAIRED}, r AS (SELECT rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2 AS a, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2 AS b FROM t) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman_ties(spark, d):
    return M.spearman(_paired(spark, d), "truth", "pred").select(r6("spearman", "spearman"))


@query(f"{PAIRED} SELECT round(corr(truth, pred), 6) AS pearson, count(*) FILTER (truth > 500 AND pred > 500) AS both, count(*) FILTER (truth > 500 AND pred <= 500) AS only_a, count(*) FILTER (truth <= 500 AND pred > 500) AS only_b FROM t")
def pairwise(spark, d):
    return M.pairwise(_paired(spark, d), "truth", "pred", 500.0).withColumn("pearson", F.round("pearson", 6))


@query(f"{PAIRED} SELECT k, truth, pred, round(log2((pred + 1) / (truth + 1)), 6) AS log2_change FROM t WHERE truth + pred >= 50 ORDER BY abs(round(log2((pred + 1) / (truth + 1)), 6)) DESC, k LIMIT 25")
def top_outliers(spark, d):
    return M.top_outliers(_paired(spark, d), "truth", "pred", "k", 50, 25)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY 1, 2")
def group_summary(spark, d):
    got = M.summary(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return got.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median")])


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type <> 'click' AND value <= 50) AS other_low FROM events")
def counters(spark, d):
    return R.counters(table(spark, d, "events"), {"total": F.lit(True), "clicks": F.col("event_type") == "click", "high": F.col("value") > 50, "other_low": (F.col("event_type") != "click") & (F.col("value") <= 50)})


@query("SELECT user_id, ts, event_type, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)")
def run_grouping(spark, d):
    return R.runs(table(spark, d, "events").select("user_id", "ts", "event_type"), ["user_id"], "ts", "event_type")


@query("SELECT user_id, ts, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM events")
def prefix_sum_exclusive(spark, d):
    return R.exclusive_sums(table(spark, d, "events").select("user_id", "ts", "value"), ["user_id"], ["ts"], "value", "before").select("user_id", "ts", r6("before", "before"))


@query("SELECT doc_id, reverse(translate(text, 'ACGTNacgtn', 'TGCANtgcan')) AS rc FROM documents")
def revcomp(spark, d):
    return table(spark, d, "documents").select("doc_id", S.reverse_complement(F.col("text")).alias("rc"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS gene, concat(event_id, ',x') AS notes, concat(event_type, ',z') AS tags, 3 AS n FROM events")
def kv_attrs(spark, d):
    text = F.concat(F.lit('gene_id "'), "user_id", F.lit('"; tag "'), "event_type", F.lit('"; note "'), "event_id", F.lit('"; note "x"; tag "z"; level "2 a;b"; tag "z";'))
    e = table(spark, d, "events").select("event_id", S.key_values(text).alias("kv"), S.tags(text).alias("t"))
    return e.select("event_id", F.col("kv")["gene_id"][0].alias("gene"), F.array_join(F.col("kv")["note"], ",").alias("notes"), F.array_join("t", ",").alias("tags"), F.size("kv").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE lower(replace(n_name, '_', '')) END AS gdna, CASE WHEN s_suppkey % 2 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS ss, CASE WHEN s_suppkey % 5 = 0 THEN 'rand' ELSE 'none' END AS nrna FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def condition_names(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    part = lambda cond, *text: F.when(cond, F.concat(*text))
    k = F.col("s_suppkey")
    name = F.concat_ws("_", part(k % 3 != 0, F.lit("gdna_"), F.lower(F.replace("n_name", F.lit("_"), F.lit("")))), F.when(k % 2 == 0, F.lit("ss_0.90")).otherwise(F.lit("ss_odd")), part(k % 5 == 0, F.lit("nrna_rand")))
    gdna, ss, nrna = S.condition_parts(name)
    return s.select("s_suppkey", gdna.alias("gdna"), ss.alias("ss"), nrna.alias("nrna"))


@query("WITH w AS (SELECT p_partkey, greatest(0, p_size - 10 + 1) * p_retailprice AS w FROM part) SELECT p_partkey, round(w / sum(w) OVER () * 1e6, 6) AS p FROM w")
def range_generate(spark, d):
    got = W.normalised(table(spark, d, "part"), S.place_weight(F.col("p_size"), 10.0) * F.col("p_retailprice"), "p")
    return got.select("p_partkey", r6(F.col("p") * 1e6, "p"))


@query("SELECT a, b, c FROM (SELECT unnest(range(0, 101, 20)) AS a) CROSS JOIN (SELECT unnest([0.65, 0.9, 1.0])::DOUBLE AS b) CROSS JOIN (SELECT r_regionkey AS c FROM region)")
def sweep_grid(spark, d):
    regions = [r[0] for r in table(spark, d, "region").select("r_regionkey").collect()]  # five rows
    return W.grid(spark, {"a": {"start": 0, "stop": 100, "step": 20}, "b": [0.65, 0.9, 1.0], "c": regions}).withColumn("a", F.col("a").cast("long"))

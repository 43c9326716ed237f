"""Models, positions, splits, windows and the whole run over the star schema, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import resolve
from ..functions import scalar as S
from ..operators import annotation as A
from ..operators import histograms as H
from ..operators import metrics as M
from ..operators import resolution as R
from ..operators import scoring as C
from ..operators import simulate as G
from ..operators import sweeps as W
from ..operators import training as T
from ..operators.common import cut
from ..sources import sinks
from ..streaming import molecules

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MIXTURE_ROUNDS = 5


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


def _mixture_sql() -> str:
    hist = lambda flag: f"SELECT k, coalesce(n, 0)::DOUBLE AS n FROM (SELECT unnest(range(0, 51)) AS k) LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) AS k, count(*) AS n FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1) USING (k)"
    parts = [f"pool AS ({hist('A')})", f"fixed AS (SELECT k, n / sum(n) OVER () AS r FROM ({hist('N')}))", "t0 AS (SELECT k, (n + 1) / sum(n + 1) OVER () AS g, 0.1::DOUBLE AS pi FROM pool)"]
    for i in range(MIXTURE_ROUNDS):
        parts.append(f"w{i} AS MATERIALIZED (SELECT k, n, n * pi * g / (pi * g + (1 - pi) * r) AS w FROM t{i} JOIN fixed USING (k) JOIN pool USING (k))")
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT k, (w + 1) / sum(w + 1) OVER () AS g, sum(w) OVER () / sum(n) OVER () AS pi FROM w{i})")
    return "WITH " + ", ".join(parts) + f" SELECT k, round(g, 6) AS g, round(pi, 6) AS pi FROM t{MIXTURE_ROUNDS}"


@query(_mixture_sql())
def mixture_em_k(spark, d):
    h = H.dense(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", 50, ["l_returnflag"]).collect()  # 51 bins a flag
    of = lambda flag: np.array([r.n for r in sorted((r for r in h if r.l_returnflag == flag), key=lambda r: r.k)], float)
    pi, g, _ = H.mixture_em(of("A"), of("N"), MIXTURE_ROUNDS, tol=0.0)
    return spark.createDataFrame([(k, round(float(x), 6), round(pi, 6)) for k, x in enumerate(g)], "k long, g double, pi double")


@query("WITH h AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, first_value(k) OVER (PARTITION BY l_returnflag ORDER BY n DESC, k) AS m FROM h) SELECT l_returnflag, round(coalesce(sum(n) FILTER (k = 0), 0) / sum(n), 6) AS first_share, round(sum(n) FILTER (k = 50) / sum(n), 6) AS last_share, max(m) AS mode, round(sum(n * k) / sum(n), 6) AS mean FROM m GROUP BY 1")
def hist_shape(spark, d):
    rows = H.dense(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", 50, ["l_returnflag"]).collect()  # 51 bins a flag
    models = {f: T.LengthModel(T.array_of([r for r in rows if r.l_returnflag == f], 50)) for f in {r.l_returnflag for r in rows}}
    shape = [(f, *(round(x, 6) for x in m.shape()[:2]), m.shape()[2], round(m.mean, 6)) for f, m in models.items()]
    return spark.createDataFrame(shape, "l_returnflag string, first_share double, last_share double, mode long, mean double")


@query("SELECT event_type, round((count(*) + 1.0) / (sum(count(*)) OVER () + count(*) OVER ()), 6) AS p FROM events GROUP BY 1")
def smoothed_shares(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("c"))
    return W.normalised(c, F.col("c") + 1, "p").select("event_type", r6("p", "p"))


@query("WITH p AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) AS c, sum(p_size) OVER () AS t FROM part), n AS (SELECT *, CAST(round(c::DOUBLE / t * 100000) AS BIGINT) AS n FROM p) SELECT p_partkey, n - coalesce(lag(n) OVER (ORDER BY p_partkey), 0) AS share FROM n")
def allot_shares(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    return G.allot(p, "w", 100000, ["p_partkey"], "share").select("p_partkey", F.col("share").cast("long").alias("share"))


@query("WITH w AS (SELECT p_brand, sum(p_retailprice * greatest(p_size - 9, 0)) FILTER (p_type LIKE 'P%') AS a, sum(p_retailprice * greatest(p_size - 9, 0)) AS t FROM part GROUP BY 1) SELECT p_brand, CAST(round(coalesce(a / nullif(t, 0), 0) * 1000) AS BIGINT) AS first_pool, 1000 - CAST(round(coalesce(a / nullif(t, 0), 0) * 1000) AS BIGINT) AS second_pool FROM w")
def pool_split(spark, d):
    w = F.col("p_retailprice") * F.greatest(F.col("p_size") - 9, F.lit(0))
    first, second = W.two_pools(F.when(F.col("p_type").startswith("P"), w), w, 1000)
    return table(spark, d, "part").groupBy("p_brand").agg(first.alias("first_pool"), second.alias("second_pool"))


@query("WITH t AS (SELECT l_suppkey, sum(l_quantity) AS truth, sum(l_quantity * (1 - l_discount)) AS pred FROM lineitem GROUP BY 1) SELECT n_name, round(sum(truth), 4) AS truth, round(sum(pred), 4) AS pred, round((sum(pred) - sum(truth)) / nullif(sum(truth), 0), 6) AS rel_error FROM t JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def pool_metrics(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("truth"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("pred"))
    got = li.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return M.pool_metrics(got, ["n_name"], "truth", "pred").select("n_name", F.round("truth", 4).alias("truth"), F.round("pred", 4).alias("pred"), r6("rel_error", "rel_error"))


@query("SELECT c_nationkey, c_custkey AS carrier FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END DESC, c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def pick_carrier(spark, d):
    return W.carriers(table(spark, d, "customer"), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"), "c_custkey")


@query("WITH b AS (SELECT l_orderkey, l_partkey, l_discount, max(l_extendedprice) AS ll, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_discount, max(l_extendedprice) DESC) AS r FROM lineitem GROUP BY 1, 2, 3) SELECT l_orderkey, l_partkey, l_discount AS overhang, ll FROM b WHERE r = 1")
def best_hit(spark, d):
    hit = F.struct(F.col("l_partkey").alias("t_index"), F.col("l_discount").alias("over"), F.col("l_extendedprice").alias("ll"))
    many = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(hit).alias("cands"))
    return many.select("l_orderkey", F.explode(F.expr(C.best_hits("cands"))).alias("c")).select("l_orderkey", F.col("c.t_index").alias("l_partkey"), F.col("c.over").alias("overhang"), "c.ll")


EXONS = "array(named_struct('start', s, 'end', s + n), named_struct('start', s + 2 * n, 'end', s + 3 * n))"
PLACED = "SELECT p_partkey, p_size + 10 AS n, CAST(p_partkey AS BIGINT) AS s, CAST(p_partkey + CAST(floor(p_retailprice) AS BIGINT) % (4 * (p_size + 10)) AS BIGINT) AS pos FROM part"


def _placed(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("int").alias("s"), (F.col("p_size") + 10).alias("n"), F.expr("cast(p_partkey + cast(floor(p_retailprice) as bigint) % (4 * (p_size + 10)) as int)").alias("pos"))
    return p.select("p_partkey", "n", F.expr(EXONS).alias("exons"), "pos", F.lit(S.NEG).alias("strand"))


@query(f"SELECT p_partkey, CASE WHEN pos >= s + 2 * n THEN n + pos - s - 2 * n ELSE pos - s END AS folded, least(greatest(pos - s, 0), n) + least(greatest(pos - s - 2 * n, 0), n) AS clamped, 2 * n - (least(greatest(pos - s, 0), n) + least(greatest(pos - s - 2 * n, 0), n)) AS mirrored FROM ({PLACED})")
def transcript_positions(spark, d):
    p = _placed(spark, d)
    return p.select("p_partkey", F.expr(R.fold_position("exons", "pos")).cast("long").alias("folded"), S.transcript_position("exons", "pos").alias("clamped"), S.transcript_position("exons", "pos", "strand").alias("mirrored"))


@query(f"""SELECT p_partkey, concat(CAST(n - a AS VARCHAR), 'M', CAST(n AS VARCHAR), 'N', CAST(z - n AS VARCHAR), 'M') AS cigar, s + a + 5 AS left_end, s + n + z - 2 AS right_start FROM (SELECT *, n // 3 AS a, n + n // 2 + 1 AS z FROM ({PLACED}))""")
def fragment_blocks(spark, d):
    p = _placed(spark, d).withColumns({"first": F.expr("cast(n div 3 as int)"), "last": F.expr("cast(n + n div 2 + 1 as int)")})
    p = p.withColumn("blocks", G.genomic_blocks("exons", "first", "last"))
    return p.select("p_partkey", G.cigar("blocks").alias("cigar"), F.element_at(G.take("blocks", 5), -1).end.cast("long").alias("left_end"), F.element_at(G.take("blocks", 2, True), 1).start.cast("long").alias("right_start"))


def _window_sql(width: int, slide: int) -> str:
    return f"WITH e AS (SELECT user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), w AS (SELECT user_id, value, unnest(range(t // {slide} * {slide} - {width - slide}, t // {slide} * {slide} + 1, {slide})) AS lo FROM e) SELECT user_id, lo, lo + {width} AS hi, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2"


def _windows(spark, d, width, slide=None):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    got = molecules.windowed(e, "ts", ["user_id"], width, slide)
    return got.select("user_id", F.unix_timestamp("lo").alias("lo"), F.unix_timestamp("hi").alias("hi"), "n", F.round("total", 4).alias("total"))


@query(_window_sql(86400, 86400))
def tumbling_windows(spark, d):
    return _windows(spark, d, "1 day")


@query(_window_sql(86400, 21600))
def sliding_windows(spark, d):
    return _windows(spark, d, "1 day", "6 hours")


@query("WITH g AS (SELECT o_custkey, o_orderkey, list(DISTINCT l_suppkey) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), f AS (SELECT o_custkey, arg_min(s, o_orderkey) AS a, arg_max(s, o_orderkey) AS b FROM g GROUP BY 1) SELECT o_custkey, CAST(len(list_intersect(a, b)) AS BIGINT) AS common, len(list_intersect(a, b)) > 0 AS overlaps, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS every FROM f")
def set_algebra(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    g = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    f = g.groupBy("o_custkey").agg(F.min_by("s", "o_orderkey").alias("a"), F.max_by("s", "o_orderkey").alias("b"))
    return f.select("o_custkey", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.arrays_overlap("a", "b").alias("overlaps"), F.size(F.array_union("a", "b")).cast("long").alias("every"))


@query("WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS expected FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS observed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed, coalesce(expected, 0) = coalesce(observed, 0) AS exact, round(abs(coalesce(observed, 0) - expected) / nullif(expected, 0), 6) AS rel_error FROM a FULL JOIN b USING (k)")
def expected_observed(spark, d):
    return M.expected_observed(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity", "l_returnflag"), ["k"], "l_returnflag", "A", "R", "l_quantity").withColumn("rel_error", F.round("rel_error", 6))


@query("""WITH p AS (SELECT l_returnflag, avg(l_quantity) FILTER (l_linestatus = 'F') AS f, avg(l_quantity) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)
SELECT 0 AS part, concat('## Quantity', chr(10), chr(10), '| l_returnflag | F | O |', chr(10), '|---|---|---|') AS line UNION ALL SELECT 1, concat('| ', l_returnflag, ' | ', coalesce(printf('%.2f', f), ''), ' | ', coalesce(printf('%.2f', o), ''), ' |') FROM p""")
def report_lines(spark, d):
    got = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return sinks.markdown(got, "Quantity", ["l_returnflag", "F", "O"], ["l_returnflag"], 2)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS t_index, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS g_index FROM customer")
def dense_ids(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_mktsegment").alias("ref"), F.col("c_mktsegment").alias("g_id"), F.col("c_custkey").alias("start"), F.col("c_custkey").alias("end"), F.lit(1).alias("strand"), F.col("c_custkey").alias("t_id"))
    return A.number(c).select("c_custkey", F.col("t_index").cast("long").alias("t_index"), F.col("g_index").cast("long").alias("g_index"))


@query("SELECT s_nationkey, round(CASE WHEN coalesce(sum(l_quantity), 0) = 0 THEN 0 ELSE coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) / sum(l_quantity) END, 6) AS rate FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1")
def contamination_rate(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("w"))
    q = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(li, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return M.contamination(q, ["s_nationkey"], F.col("l_returnflag") == "R", "w").select("s_nationkey", r6("rate", "rate"))


def _annotation(spark, d) -> DataFrame:
    """A transcript for each part, a gene for each brand and size: two or three exons, 5,000 bases for each gene."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    gene = F.concat_ws("-", "p_brand", "p_size")
    at = (F.xxhash64(gene).bitwiseAND(F.lit(0xFFFF)) * 5000).cast("int")
    exon = lambda a, b: F.struct((at + a).cast("int").alias("start"), (at + b).cast("int").alias("end"))
    exons = F.when(F.col("p_partkey") % 2 == 0, F.array(exon(0, 600), exon(1500, 2000), exon(3000, 3800))).otherwise(F.array(exon(0, 600), exon(3000, 3800 + F.col("p_size"))))
    t = p.select(F.lit("chr1").alias("ref"), exons.alias("exons"), F.when(F.xxhash64(gene) > 0, S.POS).otherwise(S.NEG).alias("strand"), F.col("p_partkey").cast("string").alias("t_id"), gene.alias("g_id"), gene.alias("g_name"), F.lit("part").alias("g_type"))
    return t.select("ref", F.col("exons")[0].start.alias("start"), F.expr("element_at(exons, -1).end").alias("end"), "strand", "t_id", "g_id", "g_name", "g_type", *[F.lit(False).alias(c) for c in ("is_basic", "is_mane", "is_ccds")], "exons", S.spliced_length("exons").alias("length"), F.lit(False).alias("is_nrna"))


@query()
def simulated_quant(spark, d):
    """Parts as transcripts, their sold quantity as abundance: simulated fragments through the whole run, by gene."""
    from ..quantify import quantify

    index = cut(A.with_nascent(A.number(_annotation(spark, d))))  # read by several jobs
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("t_id")).agg(F.sum("l_quantity").alias("abundance"), F.lit(0.0).alias("nrna_abundance"))
    n = table(spark, d, "lineitem").count()
    refs = spark.createDataFrame([("chr1", 0x10000 * 5000)], "ref string, length long")
    rows = cut(G.paired_records(G.fragments(G.file_abundances(index, sold), refs, n, 0, n // 10)))  # read by several stages
    return quantify(rows, index, resolve({"assignment_mode": "fractional"})[0]).tables["gene_quant"]


@query("SELECT n_regionkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(1.96 * stddev_pop(c_acctbal) / sqrt(count(*)), 6) AS half FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def mean_interval(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_acctbal").join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_regionkey").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal"), "mean"), r6(1.96 * F.stddev_pop("c_acctbal") / F.sqrt(F.count("*")), "half"))


@query("SELECT p_partkey, CASE WHEN c = 0 THEN 'zero' WHEN c >= 1 AND c < 10 THEN '1-10' WHEN c >= 10 AND c < 100 THEN '10-100' WHEN c >= 100 AND c < 1000 THEN '100-1000' WHEN c >= 1000 THEN '1000+' END AS bin FROM (SELECT p_partkey, coalesce(sum(l_quantity), 0) AS c FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)")
def expression_bins(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("c"))
    return table(spark, d, "part").select("p_partkey").join(c, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", M.expression_bin(F.coalesce("c", F.lit(0.0))).alias("bin"))

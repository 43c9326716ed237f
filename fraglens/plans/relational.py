"""Interval joins, set merging, components and estimation over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import resolve
from ..operators import estimation as E
from ..operators import intervals as I
from ..operators import loci as L
from ..operators import metrics as M
from ..operators import scoring as C
from ..operators import sets as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = 86400


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


def seconds(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


_ORD = f"SELECT o_orderkey, o_custkey % 100 AS g, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS s1, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 3 * {DAY} AS e1 FROM orders"
_LIN = f"SELECT DISTINCT l_orderkey, l_suppkey % 100 AS h, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS s2, CAST(floor(epoch(l_shipdate)) AS BIGINT) + 2 * {DAY} AS e2 FROM lineitem"


def _order_spans(spark, d):
    s = seconds("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("g"), s.alias("s1"), (s + 3 * DAY).alias("e1"))


def _every_line_span(spark, d):
    s = seconds("l_shipdate")
    return table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 100).alias("h"), s.alias("s2"), (s + 2 * DAY).alias("e2"))


def _line_spans(spark, d):
    return _every_line_span(spark, d).distinct()


@query(f"SELECT o_orderkey, l_orderkey, s1, s2 FROM ({_ORD}) JOIN ({_LIN}) ON g = h AND s1 < e2 AND s2 < e1")
def overlap_join(spark, d):
    got = I.overlap_pairs(_order_spans(spark, d), _every_line_span(spark, d), [("g", "h")], ("s1", "e1"), ("s2", "e2"), ("o_orderkey", "l_orderkey"), 3 * DAY, (False, True))
    return got.select("o_orderkey", "l_orderkey", "s1", "s2")


@query(f"SELECT o_orderkey, round(sum((least(e1, e2) - greatest(s1, s2)) / (e2 - s2)), 6) AS share FROM ({_ORD}) JOIN ({_LIN}) ON g = h AND s1 < e2 AND s2 < e1 GROUP BY 1")
def overlap_apportion(spark, d):
    got = I.overlap_apportion(_line_spans(spark, d).withColumn("one", F.lit(1.0)), _order_spans(spark, d), [("h", "g")], ("s2", "e2"), ("s1", "e1"), "one", ["o_orderkey"], 3 * DAY)
    return got.select("o_orderkey", F.round("share", 6).alias("share"))


_EV = "SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo FROM events"


@query(f"WITH e AS ({_EV}), i AS (SELECT event_id, user_id AS u, lo AS a, lo + 1800 AS b FROM e), o AS (SELECT user_id, event_id AS outer_id, lo AS c, lo + 43200 AS d FROM e) SELECT event_id, outer_id FROM (SELECT event_id, outer_id, row_number() OVER (PARTITION BY event_id ORDER BY c, d, outer_id) AS r FROM i JOIN o ON u = user_id AND c <= a AND b <= d) WHERE r = 1")
def containment_top1(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", seconds("ts").alias("lo"))
    inner = e.select("event_id", F.col("user_id").alias("u"), F.col("lo").alias("a"), (F.col("lo") + 1800).alias("b"))
    outer = e.select("user_id", F.col("event_id").alias("outer_id"), F.col("lo").alias("c"), (F.col("lo") + 43200).alias("d"))
    return I.containment_top1(inner, outer, [("u", "user_id")], ("a", "b"), ("c", "d"), "event_id", ["c", "d", "outer_id"], 43200).select("event_id", "outer_id")


_MERGED = f"""WITH e AS (SELECT user_id, lo, lo + 21600 AS hi FROM ({_EV})),
n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM n),
m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY user_id, island)"""


def _merged(spark, d):
    lo = seconds("ts")
    return I.merge_spans(table(spark, d, "events").select("user_id", lo.alias("lo"), (lo + 21600).alias("hi")), ["user_id"], "lo", "hi")


@query(_MERGED + " SELECT user_id, lo, hi, n FROM m")
def merge_spans(spark, d):
    return _merged(spark, d)


@query(_MERGED + ", g AS (SELECT user_id, lag(hi) OVER (PARTITION BY user_id ORDER BY lo) AS a, lo AS b FROM m) SELECT user_id, a AS lo, b AS hi FROM g WHERE a < b")
def gaps(spark, d):
    return I.gaps(_merged(spark, d), ["user_id"], "lo", "hi")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, lo AS x, row_number() OVER (PARTITION BY user_id ORDER BY lo, event_id) AS r FROM ({_EV})),
c AS (SELECT user_id, x, r, x AS anchor FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.x, e.r, CASE WHEN e.x - c.anchor > 43200 THEN e.x ELSE c.anchor END FROM c JOIN e ON e.user_id = c.user_id AND e.r = c.r + 1)
SELECT user_id, anchor, max(x) AS x_max, count(*) AS n FROM c GROUP BY 1, 2""")
def anchor_cluster(spark, d):
    return I.anchor_cluster(table(spark, d, "events").select("user_id", seconds("ts").alias("x")), ["user_id"], "x", 43200)


@query(f"WITH b AS (SELECT user_id, min(lo) AS start, CAST(lo // 86400 AS BIGINT) AS day FROM ({_EV}) GROUP BY user_id, CAST(lo // 86400 AS BIGINT)) SELECT event_id, max(day) AS day FROM ({_EV}) e JOIN b ON b.user_id = e.user_id AND start <= lo GROUP BY 1")
def point_in_partition(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", seconds("ts").alias("lo"))
    b = e.groupBy("user_id", F.floor(F.col("lo") / 86400).alias("day")).agg(F.min("lo").alias("start"))
    return I.point_in_partition(e, "lo", b, "start", ["user_id"]).select("event_id", "day")


_SETS = "SELECT l_orderkey, l_linenumber, list(DISTINCT p_size % 8 ORDER BY p_size % 8) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"


@query(f"""WITH s AS ({_SETS}), g AS (SELECT l_orderkey, count(*) AS n, flatten(list(s)) AS every FROM s GROUP BY 1),
v AS (SELECT l_orderkey, n, x, count(*) AS c FROM (SELECT l_orderkey, n, unnest(every) AS x FROM g) GROUP BY 1, 2, 3),
i AS (SELECT l_orderkey, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (c = n) AS common, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS anyone FROM v GROUP BY 1)
SELECT l_orderkey, coalesce(common, anyone) AS merged, CASE WHEN common IS NULL THEN 2 ELSE 0 END AS code FROM i""")
def set_merge(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    sets = li.groupBy("l_orderkey", "l_linenumber").agg(F.collect_set(F.col("p_size") % 8).alias("s")).groupBy("l_orderkey").agg(F.collect_list("s").alias("sets"))
    return sets.select("l_orderkey", F.array_join(S.merge_sets("sets"), ",").alias("merged"), S.merge_code("sets").alias("code"))


@query()
def connected_components(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1000000000).alias("b"))
    return S.connected_components(e, "a", "b")


@query("SELECT members, count(*) AS n_units FROM (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members FROM lineitem GROUP BY 1) GROUP BY 1")
def equivalence_classes(spark, d):
    got = S.equivalence_classes(table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("c")), "l_orderkey", "c")
    return got.select(F.array_join("members", ",").alias("members"), "n_units")


@query("SELECT l_orderkey, l_linestatus, l_extendedprice FROM (SELECT *, max(ln(l_extendedprice)) OVER (PARTITION BY l_orderkey, l_linestatus) AS best FROM lineitem) WHERE best - ln(l_extendedprice) <= 1.25")
def prune_by_pool(spark, d):
    c = F.struct((F.col("l_linestatus") == "O").alias("is_synthetic"), F.log("l_extendedprice").alias("ll"), "l_linestatus", "l_extendedprice")
    u = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(c).alias("cands"))
    return u.select("l_orderkey", F.explode(F.expr(C.pruned("cands", 1.25))).alias("c")).select("l_orderkey", "c.l_linestatus", "c.l_extendedprice")


@query("WITH m AS (SELECT user_id, value / 100 AS x, max(value / 100) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, count(*) AS n, round(max(m) + ln(avg(exp(x - m))), 6) AS lme FROM m GROUP BY 1")
def lse_mean(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.col("value") / 100).alias("x"))
    return e.select("user_id", F.size("x").cast("long").alias("n"), F.round(C.log_mean_exp("x"), 6).alias("lme"))


@query("WITH u AS (SELECT user_id % 20 AS locus, user_id, max(value) / 100 AS best FROM events GROUP BY 1, 2) SELECT locus, round(10 * avg(1 / (1 + exp(-(ln(0.3) - ln(0.7) + best - 0.5)))), 6) AS alpha FROM u GROUP BY 1")
def locus_prior(spark, d):
    u = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("locus"), "user_id").agg((F.max("value") / 100).alias("best"))
    stamped = u.select(F.col("locus").alias("locus_id"), F.col("best").alias("gdna_log_lik"), F.array(F.struct(F.lit(0.5).alias("ll"))).alias("cands"))
    return L.priors(stamped, 0.3).select(F.col("locus_id").alias("locus"), F.round("alpha_gdna", 6).alias("alpha"))


ROUNDS = 5


def _em_sql() -> str:
    parts = [
        "pairs AS (SELECT DISTINCT l_orderkey AS u, l_suppkey AS c FROM lineitem)", "sizes AS (SELECT u, count(*) AS k FROM pairs GROUP BY 1)",
        "fixed AS (SELECT c, count(*) AS n FROM pairs JOIN sizes USING (u) WHERE k = 1 GROUP BY 1)", "amb AS (SELECT u, c FROM pairs JOIN sizes USING (u) WHERE k > 1)",
        "t0 AS (SELECT c, 1.0::DOUBLE / count(*) OVER () AS theta FROM (SELECT DISTINCT c FROM pairs))",
    ]
    for i in range(ROUNDS):
        parts.append(f"p{i} AS MATERIALIZED (SELECT c, sum(theta / z) AS n FROM (SELECT c, theta, sum(theta) OVER (PARTITION BY u) AS z FROM amb JOIN t{i} USING (c)) GROUP BY 1)")
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT c, n / sum(n) OVER () AS theta FROM (SELECT c, sum(n) AS n FROM (SELECT c, n FROM p{i} UNION ALL SELECT c, n FROM fixed) GROUP BY 1))")
    return "WITH " + ", ".join(parts)


def _theta(spark, d):
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return pairs, E.em_fixed(pairs, "l_orderkey", "l_suppkey", ROUNDS)


@query(_em_sql() + f" SELECT n_name, round(sum(theta) * 1e6, 4) AS tpm, count(*) AS n FROM t{ROUNDS} JOIN supplier ON s_suppkey = c JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def em_fixed_iter(spark, d):
    _, theta = _theta(spark, d)
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    got = theta.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return got.groupBy("n_name").agg(F.round(F.sum("theta") * 1e6, 4).alias("tpm"), F.count("*").alias("n"))


@query(_em_sql() + f" SELECT u AS l_orderkey, c AS winner, round(theta / z, 6) AS posterior FROM (SELECT u, c, round(theta, 9) AS theta, sum(round(theta, 9)) OVER (PARTITION BY u) AS z, row_number() OVER (PARTITION BY u ORDER BY round(theta, 9) DESC, c) AS r FROM pairs JOIN t{ROUNDS} USING (c)) WHERE r = 1")
def em_map_winner(spark, d):
    pairs, theta = _theta(spark, d)
    cand = F.struct(F.col("l_suppkey").cast("int").alias("t_index"), F.lit(0.0).alias("ll"), F.lit(0.0).alias("bias"), F.lit(0).alias("count_col"))
    units = pairs.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list(cand).alias("cands")).select("unit", F.lit(0).alias("locus_id"), F.lit(0).alias("splice_type"), F.lit(float("-inf")).alias("gdna_log_lik"), "cands")
    state = theta.select(F.lit(0).alias("locus_id"), F.col("l_suppkey").cast("int").alias("comp"), F.round("theta", 9).alias("theta"))
    got = L.assign(units, state, resolve({"assignment_mode": "map", "assignment_min_posterior": 0.0})[0].em)
    return got.select(F.col("unit").alias("l_orderkey"), F.col("comp").cast("long").alias("winner"), F.round("posterior", 6).alias("posterior"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def semi_join(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey")
    return table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def left_fill(spark, d):
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return M.with_truth(table(spark, d, "part").select("p_partkey"), n, "p_partkey", "n")


@query("WITH a AS (SELECT l_partkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), r AS (SELECT l_partkey AS k, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, a, n, r FROM a JOIN n USING (k) JOIN r USING (k)")
def three_way_inner(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    of = lambda flag: li.filter(F.col("l_returnflag") == flag).groupBy("k").agg(F.count("*").alias(flag.lower()))
    return M.three_way(of("A"), of("N"), of("R"), "k")


@query("SELECT p_brand, p_type, count(*) AS n, CAST(grouping(p_brand) * 2 + grouping(p_type) AS BIGINT) AS level FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup_levels(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))

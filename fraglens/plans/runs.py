"""Stages of a run over the star schema, with their SQL: alignments and their counters, resolution, counts, bias, sequences.

Lines of orders are alignments or fragments, parts are genes or references, orders are molecules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import resolve
from ..functions import scalar as S
from ..operators import bias as B
from ..operators import intervals as I
from ..operators import pairing, report, resolution, sequences, stamps
from ..operators import loci as L
from ..operators.common import shared_folder
from ..sources import bam

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str):
    """Registers a query under its own name, with the SQL that gives the same rows."""

    def wrap(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return wrap


# -- alignments -------------------------------------------------------------


def alignments(spark: SparkSession, d: str) -> DataFrame:
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber").cast("int")
    cigar = F.when(n % 2 == 0, F.concat(F.lit("5M"), n.cast("string"), F.lit("N5M"))).otherwise("10M")
    return li.join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("qname"), (F.col("l_partkey") * 7 % 2048 * 2 + 1).cast("int").alias("flag"), F.col("p_brand").alias("ref"), (F.col("l_suppkey") * 10).cast("int").alias("pos"), F.col("p_size").cast("int").alias("mapq"),
        cigar.alias("cigar"), F.lit("*").alias("mate_ref"), F.lit(-1).alias("mate_pos"), (n * 100).alias("nm"), F.when(F.col("l_orderkey") % 4 == 0, n).otherwise(1).alias("nh"),
        F.when(F.col("l_orderkey") % 3 == 0, n % 3).otherwise(-1).alias("hi"), F.when(F.col("l_returnflag") == "A", "+").alias("xs"), F.when(F.col("l_returnflag") == "R", "-").alias("ts"),
    )


A = """WITH a AS (SELECT l_orderkey AS q, CAST(l_partkey * 7 % 2048 * 2 + 1 AS INT) AS flag, p_brand AS ref, l_suppkey * 10 AS pos, p_size AS mapq, l_linenumber % 2 = 0 AS spliced, l_linenumber * 100 AS nm,
  CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber ELSE 1 END AS nh, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 3 ELSE -1 END AS hi, l_returnflag AS f FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"{A} SELECT ref, count(*) AS n, count(DISTINCT q) AS names, sum(pos)::BIGINT AS pos, sum(flag)::BIGINT AS flag, sum(mapq)::BIGINT AS mapq, sum(nm)::BIGINT AS nm, sum(nh)::BIGINT AS nh, sum(hi)::BIGINT AS hi, count(*) FILTER (spliced) AS spliced, count(*) FILTER (f = 'A') AS xs, count(*) FILTER (f = 'R') AS ts, sum(nm) FILTER (mapq > 25)::BIGINT AS stamped FROM a GROUP BY ref")
def binary_alignments(spark, d):
    """Alignment rows written as binary files, read back in splits, stamped with a tag and written and read again."""
    rows = alignments(spark, d)
    refs = [(r.p_brand, 10_000_000) for r in table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]  # the brands are 25
    base, header = f"{shared_folder(spark)}/binary-{uuid.uuid4().hex}", bam.Header("@HD\tVN:1.6\n", refs)
    bam.write_bam(bam.encoded(rows, refs), header, f"{base}/plain", ["qname", "pos"])
    read = bam.read_records(spark, f"{base}/plain")
    tags = read.filter("mapq > 25").select(*bam.KEY, F.col("nm").alias("own"))
    bam.write_bam(bam.stamped(read, tags, {"ZI": ("i", "own")}), header, f"{base}/stamped", bam.KEY)
    again = bam.read_records(spark, f"{base}/stamped")
    tag = F.pandas_udf(lambda raws: raws.map(lambda r: bam.tags(r).get("ZI")).astype("Int64"), "long")
    total = lambda c: F.sum(c).cast("long").alias(c)
    return again.withColumn("z", tag("raw")).groupBy("ref").agg(
        F.count("*").alias("n"), F.count_distinct("qname").alias("names"), *map(total, ("pos", "flag", "mapq", "nm", "nh", "hi")), F.count_if(F.col("cigar").contains("N")).alias("spliced"), F.count("xs").alias("xs"), F.count("ts").alias("ts"), F.sum("z").alias("stamped"))


_KEPT = "flag & (512 | 4 | 1024) = 0"


@query(f"{A} SELECT count(*) AS total, count(*) FILTER (flag & 512 <> 0) AS qc_fail, count(*) FILTER (flag & 516 = 4) AS unmapped, count(*) FILTER (flag & 516 = 0 AND flag & 1024 <> 0) AS duplicate, count(*) FILTER ({_KEPT} AND flag & 256 <> 0) AS secondary, count(*) FILTER ({_KEPT} AND flag & 2048 <> 0) AS supplementary, count(*) FILTER ({_KEPT} AND spliced) AS n_sj_observed FROM a")
def scan_counters(spark, d):
    return stamps.scan_counts(alignments(spark, d))


@query(f"""{A}, h AS (SELECT q, greatest(hi, 0) AS hit, max(nh) AS nh, bool_or(flag & 256 <> 0) AS sec, max(hi) AS hi, bool_or(flag & 128 = 0) AS r1, bool_or(flag & 128 <> 0) AS r2,
  coalesce(bool_or(flag & 2 <> 0) FILTER (flag & 128 = 0 AND flag & 2304 = 0), false) AS proper FROM a WHERE {_KEPT} GROUP BY 1, 2),
m AS (SELECT q, max(nh) > 1 OR bool_or(sec) AS many, bool_or(sec) AND max(hi) < 0 AS loose FROM h GROUP BY 1),
s AS (SELECT * FROM h JOIN m USING (q) WHERE NOT loose)
SELECT count(*) AS n_read_names, count(*) FILTER (NOT many) AS "unique", count(*) FILTER (many) AS multimapping, (SELECT count(*) FROM s WHERE r1 AND r2 AND proper) AS proper_pair, (SELECT count(*) FROM s WHERE r1 AND r2 AND NOT proper) AS improper_pair, (SELECT count(*) FROM s WHERE NOT (r1 AND r2)) AS mate_unmapped, count(*) AS n_fragments FROM m""")
def molecule_counters(spark, d):
    return stamps.molecule_counts(alignments(spark, d))


# -- resolution -------------------------------------------------------------


def genes(spark: SparkSession, d: str) -> DataFrame:
    """A gene of 500 bases for each part, 1,000 apart; one of even size has a second transcript on the other strand."""
    p = table(spark, d, "part")
    # Places are long: of some two million parts and more the last ones lie beyond 2**31.
    start = (F.col("p_partkey") * 1000).cast("long")
    both = p.withColumn("k", F.explode(F.when(F.col("p_size") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return both.select(
        F.col("p_brand").alias("ref"), start.alias("start"), (start + 500).alias("end"), F.when(F.col("k") == 0, S.POS).otherwise(S.NEG).alias("strand"), F.concat_ws("_", "p_partkey", "k").alias("t_id"), F.array(F.struct(start.alias("start"), (start + 500).alias("end"))).alias("exons"),
        (F.col("p_partkey") * 2 + F.col("k")).cast("int").alias("t_index"), F.lit(False).alias("is_synthetic"), F.lit(None).cast("int").alias("nrna_t_index"), F.lit(500).cast("long").alias("length"),
    )


def mates(spark: SparkSession, d: str) -> DataFrame:
    """Lines 1 and 2 of an order, the least where there are several, are mates; every third order has both in the gene of line 1, and of odd orders both lie on one strand of the reference."""
    li = table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    first = li.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("own"))
    part = F.when((F.col("l_orderkey") % 3 == 0), F.col("own")).otherwise(F.col("l_partkey"))
    x = li.join(first, "l_orderkey").withColumn("part", part).join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_brand"), "part")
    k = F.col("l_linenumber")
    flag = F.when(k == 1, 99).when(F.col("l_orderkey") % 2 == 1, 147).otherwise(163)
    return x.select(
        F.col("l_orderkey").cast("string").alias("qname"), flag.alias("flag"), F.col("p_brand").alias("ref"), (F.col("part") * 1000 + 10 + 100 * (k - 1) + F.col("l_quantity")).cast("long").alias("pos"), F.lit(60).alias("mapq"), F.lit("50M").alias("cigar"),
        F.lit("*").alias("mate_ref"), F.lit(-1).alias("mate_pos"), F.lit(0).alias("nm"), F.lit(1).alias("nh"), F.lit(-1).alias("hi"), F.lit(None).cast("string").alias("xs"), F.lit(None).cast("string").alias("ts"),
    )


@query(f"""WITH one AS (SELECT l_orderkey AS o, min(l_partkey) AS p, min(l_quantity)::INT AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), two AS (SELECT l_orderkey AS o, min(l_partkey) AS p, min(l_quantity)::INT AS q FROM lineitem WHERE l_linenumber = 2 AND l_orderkey IN (SELECT o FROM one) GROUP BY 1),
f AS (SELECT one.o, one.p AS p1, CASE WHEN one.o % 3 = 0 AND two.p IS NOT NULL THEN one.p ELSE two.p END AS p2, one.p * 1000 + 10 + one.q AS s1, CASE WHEN one.o % 3 = 0 THEN one.p ELSE two.p END * 1000 + 110 + two.q AS s2 FROM one LEFT JOIN two USING (o)),
g AS (SELECT f.*, a.p_brand AS b1, a.p_size AS z, b.p_brand AS b2 FROM f JOIN part a ON a.p_partkey = p1 LEFT JOIN part b ON b.p_partkey = p2),
c AS (SELECT *, CASE WHEN p2 IS NULL OR p1 = p2 THEN {resolution.NOT_CHIMERIC} WHEN b1 <> b2 THEN {resolution.TRANS} WHEN o % 2 = 1 THEN {resolution.CIS_SAME_STRAND} ELSE {resolution.CIS_OTHER_STRAND} END AS chimera FROM g)
SELECT o AS l_orderkey, chimera, CASE WHEN chimera > {resolution.TRANS} THEN greatest(s1, s2) - least(s1, s2) - 50 END AS chimera_gap, CASE WHEN p2 IS NULL THEN 50 ELSE 100 END AS read_length,
  CASE WHEN chimera = 0 THEN CASE WHEN z % 2 = 0 THEN 2 ELSE 1 END END AS n_candidates, CASE WHEN chimera = 0 THEN z % 2 = 0 END AS ambiguous_strand, CASE WHEN chimera = 0 THEN CASE WHEN p2 IS NULL THEN 50 ELSE s2 + 50 - s1 END END AS frag_length, CASE WHEN p2 IS NULL OR o % 2 = 1 THEN 1 ELSE 3 END AS strand FROM c""")
def resolved_fragments(spark, d):
    """Chimeras, candidates, their ambiguity of strand and the length on which they agree, as the run resolves them."""
    got = resolution.resolved_once(mates(spark, d), genes(spark, d), table(spark, d, "lineitem").count())
    whole = F.col("chimera") == resolution.NOT_CHIMERIC
    lengths = F.array_distinct(F.transform("candidates", lambda c: c.frag_length))
    strands = F.array_distinct(F.transform("candidates", lambda c: c.t_strand))
    return got.select(
        F.col("qname").cast("long").alias("l_orderkey"), "chimera", F.col("chimera_gap").cast("long").alias("chimera_gap"), "read_length", F.when(whole, F.size("candidates")).alias("n_candidates"), F.when(whole, F.size(strands) > 1).alias("ambiguous_strand"),
        F.when(whole & (F.size(lengths) == 1), lengths[0].cast("long")).alias("frag_length"), "strand",
    )


@query("SELECT l_orderkey, count(DISTINCT n_regionkey) > 1 AS chimera FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def chimera_flag(spark, d):
    """Blocks of a fragment on several references, by the rule of the run: regions are references, nations transcripts."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    block = F.struct(F.col("n_regionkey").cast("string").alias("ref"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1).alias("strand"))
    per = li.groupBy("l_orderkey").agg(F.collect_list(block).alias("blocks")).withColumn("xs", F.transform("blocks", lambda b: F.array(F.lit(1))))
    kind, _ = resolution.chimera("blocks", "xs")
    return per.select("l_orderkey", (kind != resolution.NOT_CHIMERIC).alias("chimera"))


# -- counts -----------------------------------------------------------------


@query(f"""WITH u AS (SELECT l_suppkey AS t_index, l_linenumber AS c, 1.0 AS u, 0.0 AS e, 0.0 AS p, 0.0 AS pp FROM lineitem WHERE l_returnflag = 'A'),
e AS (SELECT l_suppkey, l_linenumber, 0.0, l_tax, l_discount, l_discount * l_discount FROM lineitem WHERE l_returnflag = 'N'), a AS (SELECT * FROM u UNION ALL SELECT * FROM e)
SELECT t_index, round(sum(u + e), 6)::DOUBLE AS count, round(sum(u), 6)::DOUBLE AS count_unambig, round(sum(e), 6)::DOUBLE AS count_em, round(coalesce(sum(u + e) FILTER (c // 2 = {resolution.SPLICED_ANNOT}), 0), 6)::DOUBLE AS count_spliced, round(sum(pp) / nullif(sum(p), 0), 6)::DOUBLE AS posterior_mean FROM a GROUP BY 1""")
def posterior_mean(spark, d):
    """Counts of transcripts with the mean posterior of what was assigned to them, as the run reports them."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("t_index"), F.col("l_linenumber").alias("count_col"), "l_returnflag", F.col("l_tax").cast("double").alias("weight"), F.col("l_discount").cast("double").alias("posterior"))
    sure = li.filter("l_returnflag = 'A'").groupBy("t_index", "count_col").agg(F.count("*").alias("n"))
    # What goes to the genomic component counts for no transcript.
    comp = F.when(F.col("l_returnflag") == "R", L.GDNA).otherwise(F.col("t_index")).alias("comp")
    got = report.transcript_counts(sure, li.filter("l_returnflag <> 'A'").select(comp, "count_col", "weight", "posterior"))
    return got.select("t_index", *[F.round(c, 6).alias(c) for c in got.columns if c != "t_index"])


# -- bias -------------------------------------------------------------------

BOUNDS, PARTS = (500, 1000, 2000, 4000), 20
_CLASS = " + ".join(f"(tl > {b})::INT" for b in BOUNDS)
_H = lambda z: f"(CASE WHEN {z} <= 0 THEN 0.0 WHEN {z} <= fl THEN {z} * {z} / 2.0 ELSE fl * fl / 2.0 + fl * ({z} - fl) END)"
_G = lambda y: f"(({_H(y)} - {_H(f'({y} - d)')}) / d)"


@query(f"""WITH x AS (SELECT 200 + l_partkey % 5000 AS tl, 20 + l_quantity::INT * 3 AS fl, l_suppkey * 31 AS r FROM lineitem),
y AS (SELECT tl::DOUBLE AS tl, fl::DOUBLE AS fl, (r % (tl - fl))::DOUBLE AS s, (tl - fl)::DOUBLE AS d, {_CLASS} AS class FROM x),
e AS (SELECT class, j AS part, greatest(least(s + fl, (j + 1) * tl / {PARTS}.0) - greatest(s, j * tl / {PARTS}.0), 0) AS seen, {_G(f'((j + 1) * tl / {PARTS}.0)')} - {_G(f'(j * tl / {PARTS}.0)')} AS want FROM y, range({PARTS}) t(j)),
c AS (SELECT class, part, sum(seen) AS observed, sum(want) AS expected FROM e GROUP BY 1, 2),
p AS (SELECT *, 1000.0 * expected / sum(expected) OVER (PARTITION BY class) AS share FROM c),
r AS (SELECT class, part, observed, expected, (observed + share) / (expected + share) AS r FROM p)
SELECT class, part, round(observed, 3) AS observed, round(expected, 3) AS expected, round(r / avg(r) OVER (PARTITION BY class), 6) AS density FROM r""")
def bias_profiles(spark, d):
    """Profiles of fragments along transcripts, by length class."""
    length, l = F.lit(200) + F.col("l_partkey") % 5000, F.lit(20) + F.col("l_quantity").cast("int") * 3
    f = table(spark, d, "lineitem").select(length.cast("int").alias("length"), (F.col("l_suppkey") * 31 % (length - l)).cast("int").alias("start"), l.alias("l")).select("length", "start", (F.col("start") + F.col("l")).alias("end"))
    cover = B.coverage(f, BOUNDS, PARTS)
    return cover.join(B.density(cover, 1000.0), ["class", "part"]).select(F.col("class").cast("int").alias("class"), F.col("part").cast("long").alias("part"), F.round("observed", 3).alias("observed"), F.round("expected", 3).alias("expected"), F.round("density", 6).alias("density"))


PROFILES = B.BiasProfiles((300,), ((1.6, 1.2, 0.8, 0.4), (0.5, 1.5, 1.5, 0.5)))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, 50 + l_partkey % 500 AS tl, l_suppkey % (50 + l_partkey % 500) AS s, l_quantity::INT AS fl FROM lineitem),
one AS (SELECT tl, i, CASE WHEN tl <= 300 THEN [1.6, 1.2, 0.8, 0.4] ELSE [0.5, 1.5, 1.5, 0.5] END::DOUBLE[] AS p, i * 4.0 / tl AS t FROM (SELECT DISTINCT tl FROM x), range(0, 550) r(i) WHERE i <= tl),
b AS (SELECT tl, i, (coalesce(list_sum(p[1:j]), 0) + (t - j) * p[j + 1]) * tl / 4.0 AS b FROM (SELECT *, least(floor(t), 3)::INT AS j FROM one)),
c AS (SELECT tl, list(b ORDER BY i) AS b, list(t ORDER BY i) AS t FROM (SELECT tl, i, b, sum(b) OVER (PARTITION BY tl ORDER BY i ROWS UNBOUNDED PRECEDING) AS t FROM b) GROUP BY tl)
SELECT l_orderkey, l_linenumber, round((c.b[least(x.s + fl, x.tl) + 1] - c.b[x.s + 1]) / (least(x.s + fl, x.tl) - x.s), 6)::DOUBLE AS weight,
  round(CASE WHEN fl > x.tl THEN 1 ELSE greatest((c.t[x.tl + 1] - c.t[fl] - c.t[x.tl - fl + 1]) / fl, 1) END, 5)::DOUBLE AS effective_length FROM x JOIN c ON c.tl = x.tl""")
def bias_weights(spark, d):
    """Weights and effective lengths of fragments under two profiles, against prefix sums of every base."""
    length, l = F.lit(50) + F.col("l_partkey") % 500, F.col("l_quantity").cast("int")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", length.alias("length"), (F.col("l_suppkey") % length).alias("s"), l.alias("frag"))
    return x.select("l_orderkey", "l_linenumber", F.round(PROFILES.weight(F.col("s"), F.col("s") + F.col("frag"), F.col("length")), 6).alias("weight"), F.round(PROFILES.effective_length(F.col("length"), F.col("frag")), 5).alias("effective_length"))


# -- sequences --------------------------------------------------------------

_SEQ = "(SELECT p_partkey, translate(string_agg(md5(p_partkey || '-' || i), '' ORDER BY i), '0123456789abcdef', 'ACGTACGTACGTACGT') AS g FROM part, range(10) r(i) GROUP BY 1)"


@query(f"""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' AS minus, l_suppkey % 100 AS a, l_quantity::INT AS q, l_linenumber AS k, g FROM lineitem JOIN {_SEQ} ON p_partkey = l_partkey),
s AS (SELECT *, substr(g, a + 1, q) || substr(g, a + q + 11 + k, 2 * q) AS spliced, substr(g, a + 1, 3 * q + 10 + k) AS span FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN minus THEN translate(reverse(spliced), 'ACGT', 'TGCA') ELSE spliced END AS spliced, CASE WHEN minus THEN translate(reverse(span), 'ACGT', 'TGCA') ELSE span END AS span FROM s""")
def transcript_sequences(spark, d):
    """Spliced and unspliced sequences of transcripts of two exons, cut out of references in chunks; parts are references of 320 bases."""
    # Dealt out first, or else the few bytes of the keys are one task that makes all bases.
    parts = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    runs = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(F.col("p_partkey").cast("string").alias("ref"), (F.col("i") * 32).cast("long").alias("start"), F.translate(F.md5(F.concat_ws("-", "p_partkey", "i").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("sequence"))
    chunks = sequences.chunked(runs, 50)
    a, q, k = (F.col("l_suppkey") % 100).cast("int"), F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    exon = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    t = table(spark, d, "lineitem").select(
        "l_orderkey", k.alias("l_linenumber"), "l_partkey", a.alias("a"), q.alias("q"), (F.col("l_returnflag") == "R").alias("minus"), F.col("l_partkey").cast("string").alias("ref"), a.alias("start"), (a + 3 * q + 10 + k).alias("end"),
        F.when(F.col("l_returnflag") == "R", S.NEG).otherwise(S.POS).alias("strand"), F.array(exon(a, a + q), exon(a + q + 10 + k, a + 3 * q + 10 + k)).alias("exons"),
    )
    both = sequences.spliced_and_whole(t, chunks, ["l_orderkey", "l_linenumber", "l_partkey", "a", "q", "minus"], 50, 4)
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "spliced", F.col("whole").alias("span"))


# -- groups -----------------------------------------------------------------


@query("""WITH x AS (SELECT DISTINCT l_returnflag AS ref, l_suppkey % 7 AS strand, l_partkey * 100 AS s, l_partkey * 100 + l_quantity::INT * 3 AS z, l_orderkey AS m FROM lineitem WHERE l_linenumber = 1),
w AS (SELECT *, max(z) OVER (PARTITION BY ref, strand ORDER BY s, z, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY ref, strand ORDER BY s, z, m ROWS UNBOUNDED PRECEDING) AS g FROM w)
SELECT ref, strand, min(s) AS lo, max(z) AS hi, string_agg(CAST(m AS VARCHAR), ',' ORDER BY s, z, m) AS members FROM g GROUP BY ref, strand, g""")
def overlap_groups(spark, d):
    """Overlapping spans of one strand, with their members."""
    x = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_returnflag").alias("ref"), (F.col("l_suppkey") % 7).alias("strand"), (F.col("l_partkey") * 100).alias("lo"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("int") * 3).alias("hi"), F.col("l_orderkey").alias("m")).distinct()
    return I.overlap_groups(x, ["ref", "strand"], "lo", "hi", "m").withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


# -- molecules --------------------------------------------------------------

_SIDE = "SELECT l_orderkey AS q, l_linenumber AS i, min(l_suppkey % 5) AS t FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1, 2"


@query(f"""WITH f AS ({_SIDE.format('A')}), s AS ({_SIDE.format('R')}), shared AS (SELECT f.q, f.i AS a, s.i AS b FROM f JOIN s ON s.q = f.q AND s.t = f.t),
x AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM shared h WHERE h.q = f.q AND h.a = f.i)), y AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM shared h WHERE h.q = s.q AND h.b = s.i)),
every AS (SELECT 0 AS k, q, a, b FROM shared UNION ALL SELECT 1, x.q, x.i, y.i FROM x JOIN y ON y.q = x.q UNION ALL SELECT 2, q, i, NULL FROM x WHERE q NOT IN (SELECT q FROM y) UNION ALL SELECT 2, q, NULL, i FROM y WHERE q NOT IN (SELECT q FROM x))
SELECT q AS l_orderkey, (row_number() OVER (PARTITION BY q ORDER BY k, a, b) - 1)::INTEGER AS hit, a AS first, b AS second FROM every""")
def paired_hits(spark, d):
    """Mates of molecules paired by shared transcripts, the rest crossed; returned and accepted lines are the mates, on references of their own."""
    li = table(spark, d, "lineitem")

    def side(flag: str) -> DataFrame:
        g = li.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").cast("string").alias("qname"), F.col("l_linenumber").cast("int").alias("i")).agg(F.min(F.col("l_suppkey") % 5).cast("int").alias("t"))
        return g.select("qname", "i", F.lit(flag).alias("ref"), F.lit(0).alias("pos"), F.array("t").alias("ts"))

    got = pairing.pair_hits(side("A"), side("R"))
    return got.select(F.col("qname").cast("long").alias("l_orderkey"), "hit", "first", "second")


@query(f"""WITH c AS (SELECT l_orderkey AS u, l_suppkey AS comp, -0.5 * min(l_linenumber) - ln(1 + l_suppkey % 7) + ln((l_suppkey * 13 % 17 + 1) / 100.0) AS l FROM lineitem GROUP BY 1, 2 UNION ALL SELECT DISTINCT l_orderkey, {L.GDNA}, -2.0 + ln(0.3) FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT u AS l_orderkey, comp, count(*) OVER (PARTITION BY u)::INTEGER AS n_candidates, round(exp(l) / sum(exp(l)) OVER (PARTITION BY u), 9) AS posterior, round(exp(l) / sum(exp(l)) OVER (PARTITION BY u), 9) AS weight FROM c""")
def fractional_assignment(spark, d):
    """Posteriors of units over transcripts and the genomic component, as the run assigns them fractionally."""
    each = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg((-0.5 * F.min("l_linenumber")).alias("ll"))
    cand = F.struct(F.col("l_suppkey").cast("int").alias("t_index"), "ll", (-F.log(1.0 + F.col("l_suppkey") % 7)).alias("bias"), F.lit(0).alias("count_col"))
    genomic = F.when(F.col("unit") % 2 == 0, -2.0).otherwise(float("-inf"))
    units = each.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list(cand).alias("cands")).select("unit", F.lit(0).alias("locus_id"), F.lit(0).alias("splice_type"), genomic.alias("gdna_log_lik"), "cands")
    theta = table(spark, d, "supplier").select(F.lit(0).alias("locus_id"), F.col("s_suppkey").cast("int").alias("comp"), ((F.col("s_suppkey") * 13 % 17 + 1) / 100.0).alias("theta"))
    theta = theta.unionByName(spark.range(1).select(F.lit(0).alias("locus_id"), F.lit(L.GDNA).alias("comp"), F.lit(0.3).alias("theta")))
    got = L.assign(units, theta, resolve({"assignment_mode": "fractional"})[0].em)
    return got.select(F.col("unit").alias("l_orderkey"), F.col("comp").cast("long").alias("comp"), "n_candidates", F.round("posterior", 9).alias("posterior"), F.round("weight", 9).alias("weight"))

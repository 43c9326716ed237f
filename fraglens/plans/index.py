"""Index tables, look-ups, text formats and alignment parsing over the star schema, with their SQL.

Parts are transcripts: of one exon, or of two where their size is even. Lines of orders are alignments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import annotation as A
from ..operators import fragments as G
from ..operators import resolution as R
from ..sources import annotation as N
from ..sources import results, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LENGTH, BARE = 10200, 500


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str):
    """Registers a query under its own name, with the SQL that gives the same rows."""

    def wrap(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return wrap


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    p, key, n = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    s = key * 37 % 10000
    exon = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    exons = F.when(n % 2 == 0, F.array(exon(s, s + n), exon(s + 2 * n, s + 3 * n))).otherwise(F.array(exon(s, s + n)))
    t = p.select(
        F.col("p_brand").alias("ref"), s.cast("int").alias("start"), F.element_at(exons, -1).end.alias("end"), F.when(key % 2 == 1, S.POS).otherwise(S.NEG).alias("strand"), F.concat(F.lit("T"), key).alias("t_id"),
        F.concat(F.lit("G"), F.floor(key / 3)).alias("g_id"), F.col("p_type").alias("g_name"), exons.alias("exons"), (key - 1).cast("int").alias("t_index"), F.floor(key / 3).cast("int").alias("g_index"), (n > 45).alias("is_synthetic"),
        (key - 1 - (key - 1) % 5).cast("int").alias("nrna_t_index"), (key % 2 == 0).alias("is_basic"), (key % 3 == 0).alias("is_mane"), (key % 5 == 0).alias("is_ccds"),
    )
    return t.withColumn("length", S.spliced_length("exons"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "part").select(F.col("p_brand").alias("ref"), F.lit(LENGTH).cast("long").alias("length")).distinct()
    return refs.unionByName(spark.range(1).select(F.lit("bare").alias("ref"), F.lit(BARE).cast("long").alias("length")))


T = f"""WITH t AS (SELECT p_partkey - 1 AS t_index, p_brand AS ref, p_partkey * 37 % 10000 AS s, p_size AS n, p_partkey * 37 % 10000 + CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END * p_size AS z, p_size % 2 = 0 AS two,
  CASE WHEN p_partkey % 2 = 1 THEN {S.POS} ELSE {S.NEG} END AS strand, 'T' || p_partkey AS t_id, p_partkey // 3 AS g, 'G' || (p_partkey // 3) AS g_id, p_type AS g_name, p_size > 45 AS syn, p_partkey AS k FROM part),
  e AS (SELECT *, s AS a, s + n AS b FROM t UNION ALL SELECT *, s + 2 * n, s + 3 * n FROM t WHERE two)"""
LINES = "lineitem JOIN part ON p_partkey = l_partkey"


def spans(df: DataFrame, *more: str) -> DataFrame:
    return df.select("ref", F.col("start").alias("lo"), F.col("end").alias("hi"), *more)


@query(f"{T} SELECT ref, a AS lo, b AS hi, strand, {A.EXON} AS interval_type, t_index FROM e UNION ALL SELECT ref, s, z, strand, {A.TRANSCRIPT}, t_index FROM t")
def index_intervals(spark, d):
    return spans(A.transcript_intervals(transcripts(spark, d)), "strand", "interval_type", "t_index")


@query(f"{T} SELECT ref, s + n AS lo, s + 2 * n AS hi, strand, t_index FROM t WHERE two")
def index_junctions(spark, d):
    return spans(A.junctions(transcripts(spark, d)), "strand", "t_index")


@query(f"{T}, w AS (SELECT ref, s, max(z) OVER (PARTITION BY ref ORDER BY s, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t) SELECT ref, m AS lo, s AS hi FROM w WHERE s > m UNION ALL SELECT ref, 0, min(s) FROM t GROUP BY ref HAVING min(s) > 0 UNION ALL SELECT ref, max(z), {LENGTH} FROM t GROUP BY ref UNION ALL SELECT 'bare', 0, {BARE}")
def index_between(spark, d):
    return spans(A.intergenic(transcripts(spark, d), lengths(spark, d)))


@query(f"{T} SELECT g AS g_index, g_id, arg_min(g_name, t_index) AS g_name, arg_min(ref, t_index) AS ref, min(s) AS lo, max(z) AS hi, arg_min(strand, t_index) AS strand, count(*) AS n_transcripts FROM t GROUP BY 1, 2")
def gene_table(spark, d):
    return spans(A.genes(transcripts(spark, d)), "g_index", "g_id", "g_name", "strand", "n_transcripts")


COLLAPSED = f"{T}, u AS (SELECT ref, a, b, 0 AS kind, t_index, strand FROM e WHERE NOT syn UNION ALL SELECT ref, s, z, 1, t_index, strand FROM t WHERE NOT syn), c AS (SELECT ref, a AS lo, b AS hi, kind, string_agg(CAST(t_index AS VARCHAR), ',' ORDER BY t_index) AS members, bool_or(strand = {S.POS}) AS pos, bool_or(strand = {S.NEG}) AS neg FROM u GROUP BY 1, 2, 3, 4)"


def shown(index: DataFrame) -> DataFrame:
    return spans(index, "kind", F.array_join(F.transform("members", lambda m: m.t_index.cast("string")), ",").alias("members"), "pos", "neg")


@query(f"{COLLAPSED} SELECT * FROM c")
def index_collapse(spark, d):
    return shown(R.collapsed_index(transcripts(spark, d)))


@query(f"{COLLAPSED} SELECT * FROM c WHERE ref = 'Brand#11' AND lo < 5000 AND hi > 1000")
def index_point_query(spark, d):
    return shown(A.query_point(R.collapsed_index(transcripts(spark, d)), "Brand#11", 1000, 5000))


@query(f"{T} SELECT p.t_id AS nrna_id, t.t_id, t.g_id, t.g_name FROM t JOIN t AS p ON p.t_index = t.t_index - t.t_index % 5 WHERE NOT t.syn")
def nascent_members(spark, d):
    return A.nascent_members(transcripts(spark, d))


@query(f"{T} SELECT count(DISTINCT g) AS n_genes, count(DISTINCT g) FILTER (NOT syn) AS n_annotated_genes, count(*) AS n_transcripts, count(*) FILTER (NOT syn) AS n_annotated_transcripts FROM t")
def index_counts(spark, d):
    return A.counts(transcripts(spark, d))


@query(f"{T} SELECT t_id FROM t WHERE k % 10 = 0")
def flagged_transcripts(spark, d):
    return A.select_flagged(transcripts(spark, d), basic=True, ccds=True).select("t_id")


@query(f"{T} SELECT concat_ws(chr(9), ref, s, z, t_id, '0', CASE WHEN strand = {S.NEG} THEN '-' ELSE '+' END, s, z, '0', CASE WHEN two THEN 2 ELSE 1 END, CASE WHEN two THEN n || ',' || n ELSE CAST(n AS VARCHAR) END, CASE WHEN two THEN '0,' || (2 * n) ELSE '0' END) AS value FROM t")
def bed_lines(spark, d):
    return sinks.bed12(transcripts(spark, d))


@query(f"{T} SELECT ref, s AS lo, z AS hi, t_id, g_id, g_name, strand, n * CASE WHEN two THEN 2 ELSE 1 END AS length, CASE WHEN two THEN 2 ELSE 1 END AS n_exons FROM t")
def annotation_round_trip(spark, d):
    """Transcripts to annotation lines and back."""
    got = N.transcripts(N.parse_gtf(sinks.gtf_lines(transcripts(spark, d))))
    return spans(got, "t_id", "g_id", "g_name", "strand", "length", F.size("exons").alias("n_exons"))


@query(f"{T}, k AS (SELECT ref, s + n AS a, s + 2 * n AS b, strand AS js, list_sort(list(DISTINCT t_index)) AS jt FROM t WHERE two AND NOT syn GROUP BY 1, 2, 3, 4), j AS (SELECT l_orderkey AS qname, l_linenumber AS hit, ref, s + n + l_linenumber // 6 AS a, s + 2 * n AS b, l_linenumber % 3 AS sj, l_returnflag = 'R' AS bad FROM lineitem JOIN t ON t_index = l_partkey - 1 WHERE two), m AS (SELECT *, coalesce(NOT bad AND jt IS NOT NULL AND (sj NOT IN ({S.POS}, {S.NEG}) OR sj = js), false) AS fits FROM j LEFT JOIN k USING (ref, a, b)) SELECT qname, hit, ref, a AS lo, b AS hi, coalesce(array_to_string(list_sort(list_distinct(flatten(list(jt) FILTER (fits)))), ','), '') AS members, bool_and(bad) AS bad, coalesce(bit_or(js) FILTER (fits), 0) AS js FROM m GROUP BY 1, 2, 3, 4, 5")
def junction_match(spark, d):
    t = transcripts(spark, d)
    first, second = F.col("exons")[0].end, F.col("exons")[1].start
    two = t.filter(F.size("exons") == 2).select("ref", "t_index", first.alias("a"), second.alias("end"))
    li = table(spark, d, "lineitem").withColumn("t_index", (F.col("l_partkey") - 1).cast("int"))
    j = li.join(two, "t_index").select(F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("hit"), "ref", (F.col("a") + F.floor(F.col("l_linenumber") / 6)).cast("int").alias("start"), "end", (F.col("l_linenumber") % 3).cast("int").alias("sj_strand"), (F.col("l_returnflag") == "R").alias("bad"))
    got = R.match_junctions(j, R.known_junctions(t))
    return spans(got, "qname", "hit", F.array_join(F.array_sort("m").cast("array<string>"), ",").alias("members"), "bad", "js")


BLACK = "SELECT l_returnflag AS ref, l_suppkey AS lo, l_suppkey + l_linenumber AS hi, max(CAST(l_quantity AS INT)) AS max_anchor_left, max(l_partkey % 20) AS max_anchor_right FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2, 3"


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    place = (F.col("l_returnflag").alias("chrom"), F.col("l_suppkey").alias("intron_start"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("intron_end"))
    return table(spark, d, "lineitem").select(*place, F.col("l_linenumber").alias("count"), F.col("l_quantity").cast("int").alias("max_anchor_left"), (F.col("l_partkey") % 20).alias("max_anchor_right"))


@query(BLACK)
def splice_blacklist(spark, d):
    return spans(N.splice_blacklist(artifacts(spark, d)), "max_anchor_left", "max_anchor_right")


@query(f"WITH b AS ({BLACK}) SELECT l_orderkey, l_linenumber, coalesce(l_linenumber * 3 <= max_anchor_left OR l_linenumber <= max_anchor_right, false) AS bad FROM lineitem LEFT JOIN b ON ref = l_returnflag AND lo = l_suppkey AND hi = l_suppkey + l_linenumber")
def rejected_junctions(spark, d):
    n = F.col("l_linenumber")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("ref"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + n).alias("end"), (n * 3).alias("left"), n.alias("right"))
    return G.mark_rejected(j, N.splice_blacklist(artifacts(spark, d))).select("l_orderkey", "l_linenumber", "bad")


@query("WITH x AS (SELECT l_orderkey, l_linenumber AS k, CAST(l_quantity AS INT) AS q, l_suppkey * 100 AS p FROM lineitem) SELECT l_orderkey, k AS l_linenumber, concat(p, '-', p + q, ',', p + q + k + 10, '-', p + q + k + 10 + q + 9) AS blocks, concat(p + q, '-', p + q + k + 10, ':', q, ':', q + 9) AS junctions FROM x")
def alignment_blocks(spark, d):
    k, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    text = F.concat(k, F.lit("S"), q, F.lit("M"), (F.col("l_linenumber") + 10).cast("string"), F.lit("N"), q, F.lit("=2I5M3D1X4H"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("cigar"), (F.col("l_suppkey") * 100).alias("pos"))
    blocks, introns = G.cigar_blocks("cigar", "pos")
    spell = lambda c, *names: F.array_join(F.transform(c, lambda b: F.concat(b.start, F.lit("-"), b.end, *[F.concat(F.lit(":"), b[n]) for n in names])), ",")
    return x.select("l_orderkey", "l_linenumber", blocks.alias("b"), introns.alias("j")).select("l_orderkey", "l_linenumber", spell("b").alias("blocks"), spell("j", "left", "right").alias("junctions"))


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN {S.POS} WHEN 'R' THEN {S.NEG} END AS xs, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_linestatus = 'O' THEN {S.POS} ELSE {S.NEG} END END AS ts, l_linenumber % 3 = 0 AS rev FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(xs, CASE WHEN rev THEN {S.POS} + {S.NEG} - ts ELSE ts END, {S.NONE}) AS strand FROM x")
def junction_strand(spark, d):
    xs = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-")
    ts = F.when(F.col("l_linenumber") % 2 == 0, F.when(F.col("l_linestatus") == "O", "+").otherwise("-"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.junction_strand(xs, ts, F.col("l_linenumber") % 3 == 0).alias("strand"))


@query(f"SELECT 'q' || l_orderkey AS qname, CAST(l_partkey * 7 % 4096 AS INT) AS flag, p_brand AS ref, l_suppkey AS pos, p_size AS mapq, p_size || 'M' AS cigar, p_brand AS mate_ref, l_suppkey + 5 AS mate_pos, l_linenumber % 4 AS nm, l_linenumber AS nh, l_linenumber % 3 - 1 AS hi, CASE WHEN l_returnflag = 'A' THEN '+' END AS xs, CASE WHEN l_returnflag = 'R' THEN '-' END AS ts FROM {LINES}")
def alignment_round_trip(spark, d):
    """Alignment rows to text and back."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber").cast("int")
    rows = li.select(
        F.concat(F.lit("q"), "l_orderkey").alias("qname"), (F.col("l_partkey") * 7 % 4096).cast("int").alias("flag"), F.col("p_brand").alias("ref"), F.col("l_suppkey").cast("int").alias("pos"), F.col("p_size").cast("int").alias("mapq"), F.concat("p_size", F.lit("M")).alias("cigar"),
        F.col("p_brand").alias("mate_ref"), (F.col("l_suppkey") + 5).cast("int").alias("mate_pos"), (n % 4).alias("nm"), n.alias("nh"), (n % 3 - 1).alias("hi"), F.when(F.col("l_returnflag") == "A", "+").alias("xs"), F.when(F.col("l_returnflag") == "R", "-").alias("ts"),
    )
    return N.parse_sam(results.sam_lines(rows))

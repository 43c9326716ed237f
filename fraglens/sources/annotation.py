"""Text sources: gene annotation (GTF), reference lengths (.fai), alignments (SAM), junction lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

FIELDS = ("seqname", "source", "feature", "start", "end", "score", "strand", "phase", "attributes")
ALIGNMENT_SCHEMA = "qname string, flag int, ref string, pos int, mapq int, cigar string, mate_ref string, mate_pos int, nm int, nh int, hi int, xs string, ts string"


def parse_gtf(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """Records of annotation lines (column ``value``), 0-based half-open; ``strict`` raises on a bad line, ``skip`` drops it."""
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select("value", F.split("value", "\t").alias("f"))
    start, end, score = (F.get("f", F.lit(i)).try_cast(t) for i, t in ((3, "int"), (4, "int"), (5, "double")))
    phase, strand = F.get("f", F.lit(7)), F.get("f", F.lit(6))
    good = (F.size("f") >= 9) & start.isNotNull() & end.isNotNull() & (score.isNotNull() | (F.get("f", F.lit(5)) == ".")) & phase.isin(".", "0", "1", "2") & strand.isin(".", "+", "-", "?")
    if mode == "strict":
        rows = rows.withColumn("f", F.when(F.coalesce(good, F.lit(False)), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("bad annotation line: "), "value")).cast("array<string>")))
    else:
        rows = rows.filter(good)
    a = F.col("f")[8]
    return rows.select(
        F.col("f")[0].alias("seqname"), F.col("f")[1].alias("source"), F.col("f")[2].alias("feature"), (start - 1).alias("start"), end.alias("end"), score.alias("score"),
        S.strand_code(F.col("f")[6]).alias("strand"), F.when(F.col("f")[7] != ".", F.col("f")[7].cast("int")).alias("phase"), S.key_values(a).alias("attrs"), S.tags(a).alias("tags"),
    )


def read_gtf(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Plain or gzip text."""
    return parse_gtf(spark.read.text(path), mode)


def transcripts(records: DataFrame) -> DataFrame:
    """(ref, start, end, strand, t_id, g_id, g_name, g_type, flags, exons, length, is_nrna): exon records by transcript."""
    first = lambda k: F.element_at(F.element_at("attrs", F.lit(k)), 1)
    e = records.filter("feature = 'exon'").select("seqname", "start", "end", "strand", first("transcript_id").alias("t_id"), first("gene_id").alias("g_id"), first("gene_name").alias("g_name"), F.coalesce(first("gene_type"), first("gene_biotype")).alias("g_type"), "tags")
    got = e.groupBy("t_id").agg(
        F.min("seqname").alias("ref"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand"), F.min("g_id").alias("g_id"), F.min("g_name").alias("g_name"), F.min("g_type").alias("g_type"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"),
    )
    has = lambda *t: F.arrays_overlap("tags", F.array(*map(F.lit, t)))
    return got.select(
        "ref", "start", "end", "strand", "t_id", "g_id", F.coalesce("g_name", "g_id").alias("g_name"), "g_type", has("basic").alias("is_basic"), has("MANE_Select", "MANE_Plus_Clinical").alias("is_mane"), has("CCDS").alias("is_ccds"),
        "exons", S.spliced_length("exons").alias("length"), (F.size("exons") == 1).alias("is_nrna"),
    )


def read_reference_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(ref, length) of the text index of a FASTA file."""
    return spark.read.schema("ref string, length long, offset long, bases long, width long").csv(path, sep="\t").select("ref", "length")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of SAM text, plain or gzip."""
    return parse_sam(spark.read.text(path))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment rows of SAM lines (column ``value``), 0-based; NM defaults to 0, NH to 1, HI to -1."""
    f = lines.filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    tag = lambda t, k: F.regexp_extract(F.array_join(F.slice("f", 12, 1000), "\t"), rf"(?:^|\t){t}:{k}:([^\t]*)", 1)
    num = lambda t, default: F.coalesce(F.nullif(tag(t, "i"), F.lit("")).cast("int"), F.lit(default))
    g = lambda i: F.col("f")[i]
    return f.select(
        g(0).alias("qname"), g(1).cast("int").alias("flag"), g(2).alias("ref"), (g(3).cast("int") - 1).alias("pos"), g(4).cast("int").alias("mapq"), g(5).alias("cigar"), F.when(g(6) == "=", g(2)).otherwise(g(6)).alias("mate_ref"), (g(7).cast("int") - 1).alias("mate_pos"),
        num("NM", 0).alias("nm"), num("NH", 1).alias("nh"), num("HI", -1).alias("hi"), F.nullif(tag("XS", "A"), F.lit("")).alias("xs"), F.nullif(tag("ts", "A"), F.lit("")).alias("ts"),
    )


def strand_tag(alignments: DataFrame) -> DataFrame:
    """(tag): which tags tell the strand of spliced rows that are mapped and passed quality control: XS,ts or XS or ts or none."""
    spliced = alignments.filter((F.col("flag").bitwiseAND(F.lit(0x4 | 0x200)) == 0) & F.col("cigar").contains("N"))
    xs, ts = F.coalesce(F.max(F.col("xs").isNotNull()), F.lit(False)), F.coalesce(F.max(F.col("ts").isNotNull()), F.lit(False))
    return spliced.agg(F.when(xs & ts, "XS,ts").when(xs, "XS").when(ts, "ts").otherwise("none").alias("tag"))


def tag_order(spec: str) -> tuple[str, ...]:
    """Tags named by a setting, in the order in which they are asked: auto, none, or XS and ts by commas."""
    names = tuple(x.strip() for x in spec.split(",") if x.strip())
    if names in (("auto",), ()):
        return ("XS", "ts")
    if names == ("none",):
        return ()
    if set(names) - {"XS", "ts"}:
        raise ValueError(f"unknown strand tag: {spec}")
    return names


def splice_blacklist(rows: DataFrame, least: int = 2) -> DataFrame:
    """(ref, start, end, max_anchor_left, max_anchor_right) of junction rows seen at least ``least`` times."""
    kept = rows.filter(F.col("count") >= least).groupBy(F.col("chrom").alias("ref"), F.col("intron_start").alias("start"), F.col("intron_end").alias("end"))
    return kept.agg(F.max("max_anchor_left").alias("max_anchor_left"), F.max("max_anchor_right").alias("max_anchor_right")).orderBy("ref", "start", "end")

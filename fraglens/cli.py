"""Command line: index, quant, sim, export."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import quantify as Q
from .config import FLAGS, dump, resolve
from .operators import sequences, sweeps
from .operators import simulate as M
from .operators.common import cut
from .sources import annotation as N
from .sources import bam, index_tables, results, sinks

CHOICES = {"bias": ("uniform", "estimated")}
SWITCHES = ("keep_duplicates", "no_multimap")
NUMBERS = {"overhang_alpha": float, "mismatch_alpha": float, "pruning_min_posterior": float, "max_frag_length": int, "fl_prior_ess": float, "exon_fit_tolerance_bp": int, "em_iterations": int, "em_tolerance": float, "assignment_min_posterior": float, "seed": int}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fraglens")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="annotation to index tables")
    i.add_argument("--gtf", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--parse-mode", choices=("strict", "skip"), default="strict")
    i.add_argument("--bed", action="store_true")
    i.add_argument("--references", help=".fai of the genome, for what lies between transcripts")
    i.add_argument("--artifacts", help="Parquet of junctions that are artifacts of mapping, with their counts and anchors")
    i.add_argument("--tsv", action="store_true", help="mirrors of the tables as text")
    q = sub.add_parser("quant", help="alignments and an index to abundances")
    q.add_argument("--alignments", required=True, help="SAM text, BAM or Parquet")
    q.add_argument("--index", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--config", help="JSON text of settings, such as a run writes; given flags go before it")
    q.add_argument("--annotated", help="folder for the alignments with tags: binary files in the order of binary input, else SAM text")
    for name in FLAGS:
        flag = "--" + name.replace("_", "-")
        q.add_argument(flag, action="store_const", const=True) if name in SWITCHES else q.add_argument(flag, type=NUMBERS.get(name, str), choices=CHOICES.get(name))
    s = sub.add_parser("sim", help="simulated alignments of an index, and reads of a genome")
    for name, kind in (("--index", str), ("--references", str), ("--out", str)):
        s.add_argument(name, type=kind, required=True)
    for name, kind, default in (("--mrna", int, 1000), ("--nrna", int, 0), ("--gdna", int, 0), ("--seed", int, 0), ("--strand-specificity", float, 1.0), ("--error-rate", float, 0.0), ("--read-length", int, 100)):
        s.add_argument(name, type=kind, default=default)
    s.add_argument("--strand-kappa", type=float, help="concentration of the share of plus fragments of genomic regions; a half everywhere without it")
    s.add_argument("--nascent", type=float, nargs=2, default=(0.0, 0.3), metavar=("LOW", "HIGH"), help="nascent part of the abundance of a transcript")
    s.add_argument("--genome", help="FASTA of the references; without it, reads are of random bases with the motifs of splice sites")
    s.add_argument("--fastq", help="folder for the reads")
    s.add_argument("--bam", help="folder for the alignments as binary files, by name")
    w = sub.add_parser("sweep", help="simulations and runs over a grid of settings; finished points are skipped")
    for name in ("--index", "--references", "--grid", "--out"):
        w.add_argument(name, required=True, help="JSON text: a value, a list, or start, stop and step for each setting" if name == "--grid" else None)
    e = sub.add_parser("export", help="tables of a folder to tab-separated text or Parquet")
    e.add_argument("--tables", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--kind", choices=("tsv", "parquet"), default="tsv")
    return p


def _simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    lengths = N.read_reference_lengths(spark, a.references)
    t = M.valid_exons(spark.read.parquet(f"{a.index}/transcripts"), lengths)
    t = M.spike_nascent(M.abundances(t, a.seed), a.seed, *a.nascent)
    c = M.SimConfig(seed=a.seed, strand_specificity=a.strand_specificity, error_rate=a.error_rate, read_length=a.read_length, strand_kappa=a.strand_kappa)
    frags = cut(M.fragments(t, lengths, a.mrna, a.nrna, a.gdna, c))
    rows = M.paired_records(frags, a.read_length)
    sinks.write_table(rows, a.out)
    if a.bam:
        refs = [tuple(r) for r in lengths.orderBy("ref").collect()]
        bam.write_bam(bam.encoded(rows, refs), bam.Header("@HD\tVN:1.6\tSO:queryname\n", refs), a.bam, ["qname", "flag"])
    if a.fastq:
        chunks = cut(sequences.read_fasta(spark, a.genome) if a.genome else sequences.edited(sequences.random_chunks(lengths, a.seed), sequences.splice_motifs(t.filter("NOT is_synthetic"))))
        sequences.write_fastq(sequences.reads(frags, chunks, a.read_length, a.error_rate, a.seed), a.fastq)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fraglens").getOrCreate()
    if a.command == "index":
        lengths = N.read_reference_lengths(spark, a.references) if a.references else None
        blacklist = N.splice_blacklist(spark.read.parquet(a.artifacts)) if a.artifacts else None
        index_tables.write_index(Q.index(N.read_gtf(spark, a.gtf, a.parse_mode)), a.out, lengths, blacklist, a.tsv)
        if a.bed:
            t = spark.read.parquet(f"{a.out}/transcripts")
            sinks.bed12(t.filter("NOT is_synthetic")).write.text(f"{a.out}/bed")
    elif a.command == "quant":
        stored = index_tables.read_text(spark, a.config) if a.config else None
        config, unknown = resolve({k: getattr(a, k) for k in FLAGS}, stored)
        if unknown:
            print("unknown settings:", ", ".join(unknown))
        sam = a.alignments.endswith((".sam", ".sam.gz"))
        binary = a.alignments.endswith(".bam")
        heads = bam.headers(spark, a.alignments) if binary else {}
        rows = N.read_sam(spark, a.alignments) if sam else bam.read_records(spark, a.alignments, heads) if binary else spark.read.parquet(a.alignments)
        index = index_tables.read_index(spark, a.index)
        got = Q.quantify(rows.drop("raw"), index.transcripts, config, index.blacklist)
        for name, df in got.tables.items():
            sinks.write_table(df, f"{a.out}/{name}")
        index_tables.write_text(spark, got.summary, f"{a.out}/summary")
        index_tables.write_text(spark, dump(config), f"{a.out}/config")
        if a.annotated and binary:
            if len({tuple(h.references) for h in heads.values()}) > 1:
                raise ValueError("files of different references cannot be written as one")
            bam.write_bam(Q.annotated(rows, got, config, index.blacklist), next(iter(heads.values())), a.annotated, bam.KEY)
        elif a.annotated:
            lines = spark.read.text(a.alignments) if sam else results.sam_lines(rows)
            results.annotated_sam(lines, got.annotations).write.text(a.annotated)
    elif a.command == "sweep":
        t, lengths = cut(spark.read.parquet(f"{a.index}/transcripts")), N.read_reference_lengths(spark, a.references)
        done, there = sweeps.sweep(spark, index_tables.read_text(spark, a.grid), f"{a.out}/points", lambda point: sweeps.simulated_point(t, lengths, point))
        sinks.write_table(sweeps.sweep_summary(sweeps.sweep_results(spark, f"{a.out}/points")).withColumn("settings", F.to_json("settings")), f"{a.out}/summary", "tsv", "overwrite")
        print(f"{done} points run, {there} there already")
    elif a.command == "sim":
        _simulate(spark, a)
    else:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a.tables)
        for entry in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs):
            name = entry.getPath().getName()
            if entry.isDirectory() and name not in ("summary", "config", "manifest", "bed", "text"):
                df = spark.read.parquet(f"{a.tables}/{name}")
                flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
                sinks.write_table(df.select(*flat) if a.kind == "tsv" else df, f"{a.out}/{name}", a.kind)


if __name__ == "__main__":
    main()

"""Sinks: BED12 lines, GTF lines, tables, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def bed12(transcripts: DataFrame) -> DataFrame:
    """One line (column ``value``) for each transcript; an unknown strand is written as +."""
    joined = lambda e: F.array_join(F.transform("exons", e), ",")
    sizes, starts = joined(lambda x: (x.end - x.start).cast("string")), F.expr("array_join(transform(exons, x -> cast(x.start - start as string)), ',')")
    strand = F.when(F.col("strand") == S.NEG, "-").otherwise("+")
    cols: list[Column | str] = ["ref", "start", "end", "t_id", F.lit("0"), strand, "start", "end", F.lit("0"), F.size("exons"), sizes, starts]
    return transcripts.select(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).alias("value"))


def gtf_lines(transcripts: DataFrame) -> DataFrame:
    """Exon lines, 1-based inclusive."""
    e = transcripts.select("*", F.explode("exons").alias("e"))
    attrs = F.format_string('gene_id "%s"; transcript_id "%s"; gene_name "%s";', "g_id", "t_id", "g_name")
    return e.select(F.concat_ws("\t", "ref", F.lit("fraglens"), F.lit("exon"), (F.col("e.start") + 1).cast("string"), F.col("e.end").cast("string"), F.lit("."), S.strand_text(F.col("strand")), F.lit("."), attrs).alias("value"))


def markdown(df: DataFrame, title: str, columns: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """(part, line): a table as Markdown: title, header, and a line for each row, numbers with ``digits`` places; part 0 goes before part 1, whose lines sort by ``order``."""
    cell = lambda c, t: F.format_string(f"%.{digits}f", F.col(c).cast("double")) if t in ("double", "float") else F.col(c).cast("string")
    types = dict(df.dtypes)
    shown = [F.coalesce(cell(c, types[c]), F.lit("")) for c in columns]
    head = "\n".join((f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)))
    body = df.select(F.lit(1).alias("part"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))
    first = df.sparkSession.range(1).select(F.lit(0).alias("part"), *[F.lit(None).cast(types[c]).alias(f"_{i}") for i, c in enumerate(order)], F.lit(head).alias("line"))
    return first.unionByName(body).orderBy("part", *[f"_{i}" for i in range(len(order))]).select("part", "line")


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Parquet with zstandard, or tab-separated text with a header."""
    if kind == "tsv":
        df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)
    else:
        df.write.mode(mode).option("compression", "zstd").parquet(path)

"""Tables of other quantifiers, truth from read names, and the annotated alignment sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of known abundance tables, to ours.
FORMATS = {
    "salmon": {"Name": "transcript_id", "EffectiveLength": "effective_length", "NumReads": "count", "TPM": "tpm"},
    "kallisto": {"target_id": "transcript_id", "eff_length": "effective_length", "est_counts": "count", "tpm": "tpm"},
    "truth": {"transcript_id": "transcript_id", "mrna_abundance": "abundance", "nrna_abundance": "nrna_abundance"},
}
# Tags of annotated alignments.
TAGS = {"ZT": ("Z", "t_id"), "ZG": ("Z", "g_id"), "ZR": ("Z", "g_name"), "ZF": ("i", "flags"), "ZW": ("f", "posterior"), "ZC": ("Z", "class"), "ZN": ("i", "n_candidates"), "ZS": ("Z", "splice"), "ZL": ("i", "locus_id")}


def abundance_format(columns: list[str]) -> str:
    """The first format whose columns are all there."""
    for name, names in FORMATS.items():
        if set(names) <= set(columns):
            return name
    raise ValueError(f"unknown abundance table: {', '.join(columns)}")


def read_abundances(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text, plain or gzip, of any known format, with our column names and double values."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = FORMATS[abundance_format(df.columns)]
    return df.select(*[(F.col(a) if b == "transcript_id" else F.col(a).cast("double")).alias(b) for a, b in names.items()])


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.parquet(path) if kind == "parquet" else spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)


def fastq_truth(spark: SparkSession, path: str) -> DataFrame:
    """(pool, t_id, n) of a folder of FASTQ files, by the names of the simulator.

    Names begin with @ and hold two colons and a range, which quality lines of the simulator never do, so that lines need no numbers.
    """
    name = F.regexp_extract("value", r"^@((?:[^:\s]+):(?:[^:\s]+:)?\d+-\d+:[fr]:\d+)(?:/[12])?$", 1)
    names = spark.read.text(path).select(name.alias("qname")).filter("qname <> ''")
    from ..operators.simulate import truth

    return truth(names)


def annotated_sam(lines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """SAM lines (column ``value``) with the tags of their fragment; every line comes out once, headers and unknown names as they are."""
    sep = F.when(~F.col("value").startswith("@"), F.split("value", "\t")[0])
    tag = lambda t, kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:{kind}:"), F.col(c).cast("string")))
    got = lines.withColumn("qname", sep).join(outcomes.dropDuplicates(["qname"]), "qname", "left")
    return got.select(F.concat_ws("\t", "value", *[tag(t, k, c) for t, (k, c) in TAGS.items()]).alias("value"))


def sam_lines(alignments: DataFrame) -> DataFrame:
    """Alignment rows as SAM text, 1-based, without sequences."""
    opt = lambda t, k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:{k}:"), F.col(c).cast("string")))
    one = lambda c: (F.col(c) + 1).cast("string")
    hi = F.when(F.col("hi") >= 0, F.concat(F.lit("HI:i:"), F.col("hi").cast("string")))
    return alignments.select(F.concat_ws("\t", "qname", F.col("flag").cast("string"), "ref", one("pos"), F.col("mapq").cast("string"), "cigar", "mate_ref", one("mate_pos"), F.lit("0"), F.lit("*"), F.lit("*"), opt("NM", "i", "nm"), opt("NH", "i", "nh"), hi, opt("XS", "A", "xs"), opt("ts", "A", "ts")).alias("value"))

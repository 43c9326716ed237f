"""A corpus pipeline of five operators over the documents table.

Each stage gets what its predecessor kept and returns the columns of documents,
but for the last, which returns encodings. Rows of stages are written and read
again between them; a stage's rows are deleted when the next one's are there.

Special cases, for all stages: a null text is no language and goes with the first
stage, as does an empty one; a later stage that is given any keeps them; texts of any
length are read whole; every row is judged by itself, whatever rows share its id or
have none; repeated rows are near-duplicates of each other; an empty table stays one;
other columns than those of documents are not carried, whatever their names. Every
stage sets the session to small batches between Spark and Python.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglens.llm import bpe, decontaminate, language_gru, near_duplicates, substring_dedup
from fraglens.llm.blocks import ensure_checkpoint_dir
from fraglens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language is seen in it (no letters, null) or the best one has under this probability.
LEAST_LANGUAGE_SCORE = 0.3
#: Rows of a batch between Spark and Python: batches of long texts are held several times over, by either side.
ROWS_PER_BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's batch size for the stage that follows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    _small_batches(spark)
    got = language_gru.identify(docs, carry=tuple(COLUMNS))
    return got.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more): that with the smallest id; a row without an id only where no other is there."""
    _small_batches(spark)
    return near_duplicates.first_of_groups(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 13 or more words that an earlier document has."""
    _small_batches(spark)
    cleaned = substring_dedup.substring_dedup(docs, carry=("lang", "source", "n_chars"))
    n = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim run of ten words of a benchmark item, or the whole of a shorter one."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.decontaminate(docs, benchmark, carry=("text", "lang", "source", "n_chars"))
    return got.filter(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)"""
    _small_batches(spark)
    got = bpe.bpe_round_trip(docs, tokenizer_path())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", cut_repeats), ("decontaminate", drop_contaminated), ("bpe", encode)]
#: Near-duplicate groups and encodings are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; between them rows are written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
            if k:
                _delete(spark, f"{base}/{STAGES[k - 1][0]}")
    return docs



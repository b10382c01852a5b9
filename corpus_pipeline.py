"""A corpus pipeline: quality rules, near-duplicates, secrets, mixture, packing.

Each stage takes what its predecessor kept, as ``(spark, docs, sf_dir)``, and all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them again for the next; what else a stage
has written is removed with its end.

Defined cases are those of the operators: any column may be null, texts empty or of any length, rows repeated and tables
empty; columns beside those of ``documents`` are left out by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import mixing, packing, quality_rules, queries, secrets, simhash
from arbora.llm.common import scratch, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; counts are over this stage's documents."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return _documents(quality_rules.judge(_documents(docs), trusted).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return _documents(simhash.deduplicate(_documents(docs), k=5, radius=simhash.RADIUS, least=0.8))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced by a mark."""
    clean = secrets.redact(_documents(docs), vocabulary=queries.tokenizer()[0])
    return _documents(clean.withColumn("n_chars", F.char_length("text").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it."""
    return _documents(mixing.apply_mix(_documents(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequences."""
    return packing.pack(docs, *queries.tokenizer())


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("secret_scans", secret_scan), ("mixing", mixture), ("packing", packed)]

#: SQL has no tokenizer and no XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

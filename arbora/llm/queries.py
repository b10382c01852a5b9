"""The queries ``opN_<name>``: thin bindings of the operators to the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, language_id, mixing, packing, quality_model, quality_rules, secrets, sharding, simhash, toxicity, training
from .common import remainder


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(modulus: int, which: int):
    return F.coalesce(remainder("doc_id", modulus) == which, F.lit(False)).alias("held_out")


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(spark, _read(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), *tokenizer(), most=2048, end=0)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), least=0.93)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").where("quality = 1"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    learned = language_id.samples(docs, remainder("doc_id", 4) != 2)
    return language_id.identify(docs, learned).select("doc_id", _held(4, 2), "lang_pred", "score")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"), vocabulary=tokenizer()[0])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(_read(spark, sf_dir, "documents"), k=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scored(out: DataFrame, modulus: int, which: int) -> DataFrame:
    return out.select("doc_id", _held(modulus, which), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    sample = training.labelled_rows(docs, _read(spark, sf_dir, "labels"), "quality", remainder("doc_id", 5) != 0)
    return _scored(quality_model.score(docs, quality_model.fit(sample)), 5, 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    sample = training.labelled_rows(docs, _read(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 4) != 2)
    return _scored(toxicity.score(docs, toxicity.fit(sample)), 4, 2)


#: op9 has no hash that DuckDB lacks, so its whole result can be held against SQL.
OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS drawn FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM sources
), weighed AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM levels WHERE level * weight <= cap) * weight, cap)) AS target FROM levels
), placed AS (
  SELECT s.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY drawn, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL}

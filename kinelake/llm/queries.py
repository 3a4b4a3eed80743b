"""The operators applied to the tables, one ``opN`` query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import bitplane, katz, license_scan, mixing, ngram_join, packing, quality, secret_scan, topk_search, toxicity

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.search(vectors.filter("id % 50 = 0"), vectors)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels").filter(fold != 2))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    scored = katz.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("training")))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_ngram_join, op3_topk_search, op4_toxicity, op5_source_mix, op6_katz_score, op7_bitplane_ids, op8_concat_pack, op9_quality_rules, op10_secret_scan)}
ORACLE_SQL = {
    "op2_ngram_join": ngram_join.CLASSES_SQL,
    "op3_topk_search": topk_search.SEARCH_SQL,
    "op9_quality_rules": quality.JUDGE_SQL,
}

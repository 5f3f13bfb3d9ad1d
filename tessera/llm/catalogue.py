"""The named queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, language_id, license_scan, lm_score, minhash_dedup, packing, simhash, suffix_dedup, url_filter
from tessera.llm.common import Scratch

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer_path()).drop("_k")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = Scratch(spark).put(simhash.document_fingerprints(table(spark, sf_dir, "documents")))
    return simhash.neighbour_counts(prints)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("_k")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))  # the operator keeps one row of a repeated id


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.best_license(license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_id.fit(docs.filter(~held), "doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return lm_score.score(table(spark, sf_dir, "documents"), train).drop("_k")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_score").alias("score"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_chat_format, op4_simhash, op5_minhash_dedup, op6_license_scan, op7_language_id, op8_lm_score, op9_decontaminate, op10_url_filter)}
ORACLES: dict[str, str] = {"op3_chat_format": chat_format.ORACLE, "op6_license_scan": license_scan.oracle()}

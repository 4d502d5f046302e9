"""Queries of the training-data operators: thin digests over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, divergence, langid, licenses, quality, records, simhash, substring, token_counts, toxicity, trie
from .common import crc_bucket, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_bucket(F.col("doc_id"), 3) != 1))
    out = langid.identify(docs, model)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = crc_bucket(F.col("doc_id"), 4) != 2
    model = toxicity.fit(docs.where(learn), read_table(spark, sf_dir, "labels").where(learn))
    out = toxicity.score(docs, model, matches=False)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "clause_weight")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read_table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(read_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).drop("detections")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digests(spark, records.write(read_table(spark, sf_dir, "documents")))


def queries() -> dict:
    found = (op1_language_id, op2_bpe, op3_toxicity, op4_token_counts, op5_simhash, op6_quality, op7_substring_dedup, op8_licenses, op9_chat, op10_decontamination, op11_source_divergence, op12_conversation_trie, op13_token_records)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat": chat.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_conversation_trie": trie.ORACLE}

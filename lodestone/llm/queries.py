"""The queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, html, language, media, minhash, pii, substring, suffix_dedup, toxicity
from lodestone.llm.common import arrow_batches, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs, pii.train(docs))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *media.COLUMNS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.train(docs.where(~language.held_out()))
    return language.identify(docs.select("doc_id", "text"), net).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline, "op1_suffix_dedup": op1_suffix_dedup, "op2_decontaminate": op2_decontaminate, "op3_substring": op3_substring, "op4_pii": op4_pii, "op5_html": op5_html, "op6_minhash": op6_minhash, "op7_media": op7_media, "op8_toxicity": op8_toxicity, "op9_bpe": op9_bpe, "op10_language": op10_language}


def oracle_sql() -> dict:
    return {}

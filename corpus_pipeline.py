"""The corpus pipeline: from raw documents to token ids, in five stages.

Every stage works on all rows that its predecessor kept, is written as Parquet into the shared folder and read
again by the next, so a lost executor costs no more than the stage at hand.

Rows with a null doc_id take part: they're scored, and stay unless their text is a near copy of another row
with an id, is toxic or holds a benchmark passage. An empty table goes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, minhash, pii, toxicity
from lodestone.llm.common import Staged, arrow_batches, free_name, table, text_or_empty


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go. It learns from the labels outside its held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked at 80/100, the document of the smallest id stays."""
    return minhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; n_chars follows the text."""
    done = pii.redact(docs, pii.train(docs))
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole text; decoding them gives the text again, which `lossless` records."""
    arrow_batches(spark)
    sha = free_name(docs, "sha")
    done = docs.select("doc_id", "lang", "source", F.sha2(text_or_empty(), 256).alias(sha), bpe.encode_checked(text_or_empty()).alias("tokens"))
    return done.select("doc_id", "lang", "source", F.size("tokens.ids").cast("long").alias("n_tokens"), "tokens.ids", (F.col("tokens.decoded_sha256") == F.col(sha)).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]

#: The stages train models and compare sets of whole texts, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        now = Staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs

"""Incremental ingest of a stream of rows: each micro-batch is chunked and merged into a versioned index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunks as C
from lodestone.operators import index as I
from lodestone.operators import store


def stream_rows(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """The files of a table as a stream, under the schema of those that are there."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{directory}/{table}*")


def ingest_stream(rows: DataFrame, table: str, key: tuple[str, ...], path: str, checkpoint: str, source_id: str = "stream", embedder: str = "hashing"):
    """Starts a query that upserts row chunks into the index at `path`, whatever version it has.

    All tables of the index follow: postings, statistics and vectors too. A batch writes its own rows and the ids they
    replace, nothing else. The index remembers the last batch of each stream (told by its checkpoint), so one that is run
    again changes nothing. Of rows that repeat a key within a batch one stays.
    """
    embed = I.get_embedder(embedder)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if store.last_batch(spark, path, checkpoint) >= number:
            return
        new = I.distinct_keys(C.row_chunks(C.row_text(batch, table, key, {}, {}), table, source_id)).persist()
        added = {"chunks": new, "postings": I.postings(new), "stats": I.doc_stats(new), "vectors": embed(new)}
        store.commit(spark, path, added, new.select("chunk_id"), (checkpoint, number))
        new.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window, with late rows up to a watermark; the same on a stream and on a table."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = ts.withWatermark("ts", late) if events.isStreaming else ts
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

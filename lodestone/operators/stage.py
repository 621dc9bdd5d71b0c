"""Results that several steps read are written once, to a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ConfigError

#: Arrow batches handed to Python: rows and bytes, so that long texts don't pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Rows of a table up to which it's sent to all executors.
FEW = 200_000


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed with the session; in local mode a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame) -> DataFrame:
    """The same rows from files: the plan above stays small, nothing is computed twice, and a lost executor costs little."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rows(few: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """few joined to rows by key, without moving rows as long as `few` (staged: it's counted) has at most FEW."""
    return rows.join(F.broadcast(few) if few.count() <= FEW else few, key)

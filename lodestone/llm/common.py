"""Helpers shared by the training-data operators: staging, Arrow batches, text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches handed to Python: rows and bytes, so that long texts don't pile up in a worker.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode (tests), one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Staged:
    """A table written to the shared folder: it cuts lineage and survives lost executors.

    Shuffle files of the job that wrote it aren't needed any more and are removed when it ends.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        jvm = self.spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete it, once nothing will read it again."""
        self._fs.delete(self._at, True)


def whole_ids(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(docs with whole numbers as ids, their names): ids of another type get numbers in their own order, and names (number, name) tell which.

    Whole numbers stay what they are, and names is None. Null ids stay null.
    """
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return docs, None
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("name")).distinct().orderBy("name")
    names = Staged(known.select(F.monotonically_increasing_id().alias("number"), "name"), "ids").df
    number = free_name(docs, "number")
    rows = docs.join(names.withColumnRenamed("number", number), F.col(f"`{key}`") == F.col("name"), "left")
    return rows.select(*(F.col(number).alias(c) if c == key else docs[c] for c in docs.columns)), names


def named(found: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """Numbers of whole_ids in the given columns as ids again."""
    for c in columns if names is not None else ():
        own = names.select(F.col("number").alias("__number"), F.col("name").alias("__name"))
        found = found.join(own, F.col(c) == F.col("__number"), "left").select(*(F.col("__name").alias(x) if x == c else F.col(x) for x in found.columns))
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_struct(docs: DataFrame, found: Column, names: list[str]) -> DataFrame:
    """docs with the fields of a struct column as columns; columns of docs by these names are replaced."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    alias = free_name(docs, "found")
    return docs.select(*keep, found.alias(alias)).select(*keep, *(F.col(f"`{alias}`.`{c}`") for c in names))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by

"""Tables with declared keys: parquet carries none, so they're stated here or by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import SourceError
from lodestone.sources.base import ORDINAL, Source, Table, column_of, file_statuses  # noqa: F401


#: The star schema and the text tables. lineitem has no key of its own: its pairs of order and line repeat.
STAR = {
    t.name: t
    for t in (
        Table("region", ("r_regionkey",), {}, {"r_name": ("region name",)}),
        Table("nation", ("n_nationkey",), {"n_regionkey": "region.r_regionkey"}, {"": ("country",), "n_name": ("nation name",)}),
        Table("customer", ("c_custkey",), {"c_nationkey": "nation.n_nationkey"}, {"c_name": ("customer name",), "c_mktsegment": ("segment", "market segment"), "c_acctbal": ("account balance", "balance")}),
        Table("supplier", ("s_suppkey",), {"s_nationkey": "nation.n_nationkey"}, {"s_name": ("supplier name",), "s_acctbal": ("account balance", "balance")}),
        Table("part", ("p_partkey",), {}, {"": ("product",), "p_name": ("part name",), "p_retailprice": ("retail price", "price"), "p_brand": ("brand",), "p_type": ("type",), "p_size": ("size",)}),
        Table("orders", ("o_orderkey",), {"o_custkey": "customer.c_custkey"}, {"o_totalprice": ("total price",), "o_orderstatus": ("status", "order status"), "o_orderpriority": ("priority", "order priority"), "o_orderdate": ("order date",)}),
        Table("lineitem", (), {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"}, {"": ("line item",), "l_quantity": ("quantity",), "l_extendedprice": ("extended price",), "l_discount": ("discount",), "l_tax": ("tax",), "l_returnflag": ("return flag",), "l_linestatus": ("line status",), "l_shipdate": ("ship date",)}),
        Table("events", ("event_id",), {}, {"event_type": ("event type",)}),
        Table("documents", ("doc_id",), {}, {"lang": ("language",)}),
        Table("labels", ("doc_id",), {"doc_id": "documents.doc_id"}),
        Table("pages", ("page_id",)),
        Table("benchmark", ("item_id",)),
        Table("embeddings", ("vec_id",)),
        Table("conversations", ("conv_id", "turn")),
    )
}


class Catalog(Source):
    """The tables of one directory of parquet files, under their declared keys."""

    def __init__(self, spark: SparkSession, directory: str, tables: dict[str, Table] | None = None, source_id: str = "parquet"):
        self.spark, self.directory, self.source_id = spark, directory.rstrip("/"), source_id
        self.declared = STAR if tables is None else tables

    def tables(self) -> list[str]:
        return sorted(self.declared)

    def table(self, name: str) -> Table:
        if name not in self.declared:
            raise SourceError(f"no such table: {name}")
        return self.declared[name]

    def load(self, name: str) -> DataFrame:
        self.table(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def rows(self, name: str) -> DataFrame:
        return self.load(name) if self.table(name).key else with_ordinal(self.load(name))

    def fingerprint(self) -> str:
        """From the names, sizes and times of all files, folders' own included."""
        own = file_statuses(self.spark, self.directory)
        parts = [x for path, _, _, folder in own if folder for x in file_statuses(self.spark, path)]
        return str(hash(tuple(own + parts)))


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds the file and the 0-based place within it of each row of a parquet scan."""
    return df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias(ORDINAL))

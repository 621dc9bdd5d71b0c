"""What every source of tables offers, so that the engine works on any of them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import SchemaError

ORDINAL = "_row_ordinal"


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...] = ()
    refs: dict[str, str] = field(default_factory=dict)  # column -> table.column
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)  # column (or "" for the table) -> words for it


class Source(ABC):
    """A read-only view of tables: their names, keys and references, and each as a DataFrame.

    Columns whose names start with an underscore are the source's own (a row's place), not data.
    """

    spark: SparkSession
    source_id: str

    @abstractmethod
    def tables(self) -> list[str]:
        """The names of the tables, in order."""

    @abstractmethod
    def table(self, name: str) -> Table:
        """Key and references of a table; an unknown name is a SourceError."""

    @abstractmethod
    def load(self, name: str) -> DataFrame:
        """The rows of a table, lazily."""

    def rows(self, name: str) -> DataFrame:
        """The rows, with their place (ORDINAL) if the table has no key."""
        return self.load(name)

    def data(self, name: str) -> DataFrame:
        """The rows without the source's own columns."""
        df = self.load(name)
        return df.select(*(f"`{c}`" for c in df.columns if not c.startswith("_")))

    def fingerprint(self) -> str:
        """Changes when the data may have; empty if the source can't tell."""
        return ""

    def schema(self, name: str) -> list[dict]:
        """Name, type, nullability, key and reference of each column; key columns are never nullable."""
        t = self.table(name)
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable and f.name not in t.key, "is_key": f.name in t.key, "references": t.refs.get(f.name)} for f in self.data(name).schema.fields]

    def row_count(self, name: str) -> int:
        return self.load(name).count()

    def scan(self, name: str) -> DataFrame:
        """In the order of the effective key: the declared one, else the row's place."""
        df, key = self.rows(name), self.table(name).key
        return df.orderBy(*(key or [c for c in ("_file", ORDINAL) if c in df.columns]))

    def iter_rows(self, name: str, batch_size: int = 1000) -> Iterator[list[dict]]:
        """Batches of rows in key order, one partition at a time on the driver."""
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        batch = []
        for row in self.scan(name).toLocalIterator():
            batch.append(row.asDict())
            if len(batch) == batch_size:
                yield batch
                batch = []
        if batch:
            yield batch

    def references(self) -> list[tuple[str, str, str, str]]:
        """(table, column, other table, other column) of every declared reference."""
        return [(t, c, *r.split(".")) for t in self.tables() for c, r in self.table(t).refs.items()]

    def path(self, left: str, right: str) -> tuple[str, str] | None:
        """The columns that join two tables over one reference, in either direction."""
        for t, c, o, oc in self.references():
            if (t, o) == (left, right):
                return c, oc
            if (o, t) == (left, right):
                return oc, c
        return None

    def route(self, left: str, right: str, limit: int = 3) -> list[tuple[str, str, str]] | None:
        """The shortest chain of references: (column, next table, its column) for each hop."""
        queue, seen = [(left, [])], {left}
        while queue:
            at, hops = queue.pop(0)
            if at == right:
                return hops
            if len(hops) < limit:
                for other in self.tables():
                    if other not in seen and (p := self.path(at, other)):
                        seen.add(other)
                        queue.append((other, [*hops, (p[0], other, p[1])]))
        return None

    def close(self) -> None:
        """Nothing is held open."""


def column_of(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        raise SchemaError(f"no such column: {name}")
    return name


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def file_statuses(spark: SparkSession, directory: str) -> list[tuple[str, int, int, bool]]:
    """(path, bytes, time, is a folder) of what a directory holds, from the file system that Spark uses; [] if there's none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not path_exists(spark, directory):
        return []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(at))

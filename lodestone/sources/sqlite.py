"""SQLite files as tables, through Spark's Python data sources: no driver jar, read-only, split by rowid.

The file has to be where executors can read it, as with any file source.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.errors import SourceError
from lodestone.sources.base import Source, Table

FORMAT, SPLIT_ROWS = "lodestone_sqlite", 200_000
#: What a declared type becomes, by the part of its name that decides, in this order.
TYPES = (("BOOL", "boolean"), ("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("DATE", "string"), ("TIME", "string"), ("NUM", "double"), ("DEC", "double"))


def connect(path: str) -> sqlite3.Connection:
    found = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    found.execute("PRAGMA query_only = ON")
    return found


def spark_type(declared: str) -> str:
    return next((t for part, t in TYPES if part in (declared or "").upper()), "string")


def quoted(name: str) -> str:
    if "\x00" in name:
        raise SourceError("a name can't hold a NUL")
    return '"' + name.replace('"', '""') + '"'


class Split(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str], kinds: list[str]):
        self.path, self.table, self.names, self.kinds = options["file"], options["table"], names, kinds

    def partitions(self) -> list[Split]:
        with connect(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without rowids, or a view
                return [Split(None, None)]
        if low is None:
            return []
        return [Split(k, min(k + SPLIT_ROWS, high + 1)) for k in range(low, high + 1, SPLIT_ROWS)]

    def read(self, split: Split | None) -> Iterator[tuple]:
        if split is None:  # an empty table has no splits
            return
        where = "" if split.low is None else f" WHERE rowid >= {split.low} AND rowid < {split.high}"
        made = {"boolean": bool, "double": float, "bigint": int, "string": str, "binary": lambda v: v.encode() if isinstance(v, str) else bytes(v)}
        with connect(self.path) as db:
            for row in db.execute(f"SELECT {', '.join(map(quoted, self.names))} FROM {quoted(self.table)}{where}"):
                yield tuple(None if v is None else made[k](v) for v, k in zip(row, self.kinds))


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        with connect(self.options["file"]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1].replace('`', '``')}` {spark_type(c[2])}" for c in found)

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), schema.fieldNames(), [f.dataType.simpleString() for f in schema.fields])


class SqliteSource(Source):
    """Tables, keys and references as the file declares them."""

    def __init__(self, spark: SparkSession, path: str):
        if not os.path.exists(path):
            raise SourceError(f"no such file: {path}")
        self.spark, self.path_, self.source_id = spark, path, f"sqlite:{os.path.basename(path)}"
        spark.dataSource.register(SqliteTable)
        self._known: dict[str, Table] | None = None

    def _read(self) -> dict[str, Table]:
        if self._known is None:
            out = {}
            with connect(self.path_) as db:
                names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
                for t in names:
                    info = db.execute(f"PRAGMA table_info({quoted(t)})").fetchall()
                    key = tuple(c[1] for c in sorted((c for c in info if c[5]), key=lambda c: c[5]))
                    refs = {}
                    for _, n, other, column, theirs, *_ in db.execute(f"PRAGMA foreign_key_list({quoted(t)})").fetchall():
                        if theirs is None:  # the other table's key, in its order
                            theirs = [c[1] for c in sorted(db.execute(f"PRAGMA table_info({quoted(other)})").fetchall(), key=lambda c: c[5]) if c[5]][n]
                        refs[column] = f"{other}.{theirs}"
                    out[t] = Table(t, key, refs)
            self._known = out
        return self._known

    def tables(self) -> list[str]:
        return sorted(self._read())

    def table(self, name: str) -> Table:
        if name not in self._read():
            raise SourceError(f"no such table: {name}")
        return self._read()[name]

    def load(self, name: str) -> DataFrame:
        self.table(name)
        return self.spark.read.format(FORMAT).option("file", self.path_).option("table", name).load()

    def rows(self, name: str) -> DataFrame:
        from lodestone.sources.files import numbered

        return self.load(name) if self.table(name).key else numbered(self.load(name))

    def fingerprint(self) -> str:
        s = os.stat(self.path_)
        return f"{s.st_mtime_ns}:{s.st_size}"

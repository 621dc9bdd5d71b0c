"""A directory of CSV, TSV and Parquet files as tables: one file, one table, named by its stem."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import ConfigError, SourceError
from lodestone.sources.base import ORDINAL, Source, Table, file_statuses, path_exists

SUFFIXES = {".csv": ",", ".tsv": "\t", ".parquet": None, ".pq": None}

_OPENERS: dict[str, Callable] = {}
#: What went wrong while openers were being found; never fatal.
DISCOVERY_ERRORS: dict[str, str] = {}


def register_source(scheme: str):
    """Registers an opener for locators of the form scheme:rest."""

    def keep(opener):
        if scheme in _OPENERS:
            raise ConfigError(f"scheme registered twice: {scheme}")
        _OPENERS[scheme] = opener
        return opener

    return keep


def open_source(spark: SparkSession, locator: str):
    scheme, sep, rest = locator.partition(":")
    if not sep or scheme not in _OPENERS:
        raise ConfigError(f"no source for {scheme!r}; known: {', '.join(sorted(_OPENERS))}")
    return _OPENERS[scheme](spark, rest)


def discover(modules: list[str]) -> None:
    """Imports modules that register sources; one that fails is recorded and left out."""
    import importlib

    for m in modules:
        try:
            importlib.import_module(m)
        except Exception as e:  # noqa: BLE001
            DISCOVERY_ERRORS[m] = f"{type(e).__name__}: {e}"


def unique_names(names: list[str], reserved: tuple[str, ...] = (ORDINAL,)) -> list[str]:
    """Every name once: repeats get a number, blanks become `column`."""
    out: list[str] = []
    for raw in names:
        name, n = raw.strip() or "column", 1
        candidate = name
        while candidate in out or candidate in reserved:
            n += 1
            candidate = f"{name}_{n}"
        out.append(candidate)
    return out


def family(t: T.DataType) -> str:
    """The family of a column type; types stay native, nothing is turned into text."""
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    if isinstance(t, T.DecimalType):
        return "NUMERIC"
    if isinstance(t, T.DateType):
        return "DATE"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "TEXT"
    if isinstance(t, T.BinaryType):
        return "BLOB"
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return "JSON"
    return "UNKNOWN" if isinstance(t, T.NullType) else "OTHER"


def numbered(df: DataFrame) -> DataFrame:
    """Adds the 0-based place of each row in scan order, for scans that carry none.

    Spark numbers rows by partition; the sizes of partitions (a row for each on the driver) close the gaps.
    """
    mid = F.monotonically_increasing_id()
    marked = df.select("*", mid.alias("__m"))
    sizes = sorted((r[0], r[1]) for r in marked.groupBy(F.shiftright("__m", 33).alias("p")).count().collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    places = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)) if starts else F.create_map(F.lit(0), F.lit(0))
    at = F.element_at(places, F.shiftright("__m", 33)) + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.select(*(f"`{c}`" for c in df.columns), at.cast("long").alias(ORDINAL))


class FilesSource(Source):
    """Scans a directory. Files that can't be read are recorded in load_errors; others keep working.

    A CSV file is read once when the source is opened: its types are inferred, then all rows are parsed under them, which
    counts nulls too. Afterwards its schema is known.
    """

    def __init__(self, spark: SparkSession, directory: str, recursive: bool = False, declared: dict[str, Table] | None = None):
        self.spark, self.directory, self.source_id = spark, directory, "files:" + os.path.basename(directory.rstrip("/"))
        self.declared = declared or {}
        self.load_errors: dict[str, str] = {}
        self.paths: dict[str, str] = {}
        self._schemas: dict[str, T.StructType] = {}
        self._nulls: dict[str, dict[str, int]] = {}
        for path in self._listing(recursive):
            stem, suffix = os.path.splitext(os.path.basename(path))
            if suffix.lower() not in SUFFIXES:
                continue
            if stem in self.paths:
                self.load_errors[path] = f"table {stem} is taken by {self.paths[stem]}"
                continue
            try:
                self._open(stem, path)
                self.paths[stem] = path
            except Exception as e:  # noqa: BLE001
                self.load_errors[path] = f"{type(e).__name__}: {str(e).splitlines()[0]}"

    def _listing(self, recursive: bool) -> list[str]:
        """Paths in order, listed by the file system that Spark uses, so the directory may be in any store."""
        if not path_exists(self.spark, self.directory):
            raise SourceError(f"no such directory: {self.directory}")
        found, out = file_statuses(self.spark, self.directory), []
        while found:
            path, _, _, folder = found.pop()
            if folder and os.path.splitext(path)[1].lower() not in SUFFIXES:
                found += file_statuses(self.spark, path) if recursive else []
            else:
                out.append(path)
        return sorted(out)

    def _csv(self, path: str):
        return self.spark.read.option("sep", SUFFIXES[os.path.splitext(path)[1].lower()]).option("nullValue", "").option("emptyValue", "").option("mode", "FAILFAST").option("header", True)

    def _open(self, name: str, path: str) -> None:
        if SUFFIXES[os.path.splitext(path)[1].lower()] is None:
            self._schemas[name] = self.spark.read.parquet(path).schema
            return
        inferred = self._csv(path).option("inferSchema", True).csv(path).schema
        head = self._csv(path).option("header", False).csv(path).limit(1).first()  # Spark numbers repeated names its own way
        if head is None:
            raise SourceError(f"empty file: {path}")
        names = unique_names(["" if x is None else x for x in head])
        self._schemas[name] = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, inferred.fields)])
        checked = self._csv(path).schema(self._schemas[name]).option("enforceSchema", True).csv(path)
        self._nulls[name] = checked.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names)).first().asDict()  # every row parses, or the file is refused

    def tables(self) -> list[str]:
        return sorted(self.paths)

    def table(self, name: str) -> Table:
        if name not in self.paths:
            raise SourceError(f"no such table: {name}")
        return self.declared.get(name, Table(name))

    def load(self, name: str) -> DataFrame:
        """The table with its 0-based ordinal."""
        self.table(name)
        path = self.paths[name]
        if SUFFIXES[os.path.splitext(path)[1].lower()] is None:
            return self.spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias(ORDINAL))
        return numbered(self._csv(path).schema(self._schemas[name]).csv(path))

    def data(self, name: str) -> DataFrame:
        self.table(name)
        path = self.paths[name]
        return self.spark.read.parquet(path) if SUFFIXES[os.path.splitext(path)[1].lower()] is None else self._csv(path).schema(self._schemas[name]).csv(path)

    def fingerprint(self) -> str:
        return str(hash(tuple(file_statuses(self.spark, self.directory))))

    def null_counts(self, name: str) -> dict[str, int]:
        self.table(name)
        if name not in self._nulls:
            df = self.data(name)
            self._nulls[name] = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns)).first().asDict()
        return self._nulls[name]


@register_source("files")
def _files(spark: SparkSession, rest: str) -> FilesSource:
    return FilesSource(spark, rest)


def resolve_dsn(locator: str) -> str:
    """A database address: empty for $DATABASE_URL, $NAME for a variable, //… for postgresql://…, else as it is."""
    if not locator or locator.startswith("$"):
        name = locator[1:] or "DATABASE_URL"
        if name not in os.environ:
            raise ConfigError(f"environment variable {name} is not set")
        return os.environ[name]
    return "postgresql:" + locator if locator.startswith("//") else locator


class JdbcSource(Source):
    """Tables of a database over JDBC, read-only. Needs the driver's jar on the class path; the address is never shown.

    Tables, keys and references come from the database's information schema. Reads are split by `partition` (a numeric
    column and its bounds), where the caller gives one for a table.
    """

    def __init__(self, spark: SparkSession, url: str, schema: str = "public", timeout_s: int = 30, fetch_size: int = 1000, partition: dict[str, tuple[str, int, int, int]] | None = None):
        self.spark, self._url, self.schema_name, self.timeout_s, self.fetch_size = spark, url, schema, timeout_s, fetch_size
        self.partition, self.source_id = partition or {}, f"jdbc:{schema}"
        self._known: dict[str, Table] | None = None

    def __repr__(self) -> str:
        return "JdbcSource(...)"

    def _reader(self):
        # The session itself is read-only, so that nothing planned here can write.
        return self.spark.read.format("jdbc").options(url=self._url, queryTimeout=self.timeout_s, fetchsize=self.fetch_size, sessionInitStatement="SET default_transaction_read_only = on")

    def _query(self, sql: str) -> list[tuple]:
        try:
            return [tuple(r) for r in self._reader().option("query", sql).load().collect()]
        except Exception as e:
            raise SourceError(f"the database can't be read: {type(e).__name__}") from None

    def _read(self) -> dict[str, Table]:
        if self._known is None:
            own = "'" + self.schema_name.replace("'", "''") + "'"
            names = [r[0] for r in self._query(f"SELECT table_name FROM information_schema.tables WHERE table_schema = {own} AND table_type = 'BASE TABLE'")]
            used = f"SELECT k.table_name, k.column_name, k.ordinal_position, c.constraint_type, k.constraint_name FROM information_schema.key_column_usage k JOIN information_schema.table_constraints c ON c.constraint_name = k.constraint_name AND c.table_schema = k.table_schema AND c.table_name = k.table_name WHERE k.table_schema = {own}"
            rows = sorted(self._query(used), key=lambda r: (r[0], r[4], r[2]))
            targets = dict(self._query(f"SELECT r.constraint_name, r.unique_constraint_name FROM information_schema.referential_constraints r WHERE r.constraint_schema = {own}"))
            place = {(name, at): (t, c) for t, c, at, _, name in rows}
            keys: dict[str, list[str]] = {}
            refs: dict[str, dict[str, str]] = {}
            for t, c, at, kind, name in rows:
                if kind == "PRIMARY KEY":
                    keys.setdefault(t, []).append(c)
                elif kind == "FOREIGN KEY" and (other := place.get((targets.get(name), at))):
                    refs.setdefault(t, {})[c] = ".".join(other)
            self._known = {t: Table(t, tuple(keys.get(t, ())), refs.get(t, {})) for t in names}
        return self._known

    def tables(self) -> list[str]:
        return sorted(self._read())

    def table(self, name: str) -> Table:
        if name not in self._read():
            raise SourceError(f"no such table: {name}")
        return self._read()[name]

    def load(self, name: str) -> DataFrame:
        self.table(name)
        reader = self._reader().option("dbtable", ".".join('"' + x.replace('"', '""') + '"' for x in (self.schema_name, name)))
        if name in self.partition:
            column, low, high, parts = self.partition[name]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        try:
            return reader.load()
        except Exception as e:
            raise SourceError(f"table {name} can't be read: {type(e).__name__}") from None


@register_source("sqlite")
def _sqlite(spark: SparkSession, rest: str):
    from lodestone.sources.sqlite import SqliteSource

    return SqliteSource(spark, rest)


@register_source("postgres")
def _postgres(spark: SparkSession, rest: str) -> JdbcSource:
    return JdbcSource(spark, "jdbc:" + resolve_dsn(rest))


@register_source("parquet")
def _parquet(spark: SparkSession, rest: str):
    from lodestone.sources.catalog import Catalog

    return Catalog(spark, rest)

"""Column profiles and roles, over whole tables.

Counts, ranges and lengths take one aggregate with map-side combination. `survey` goes on from there: only columns that
this doesn't settle get an estimate of their distinct values, and only those of few values are read for what they hold,
so neither a count nor a vocabulary shuffles the others. `profile` counts distinct values exactly for every column: it unpivots the table to
(column, value) and groups by both, so that no group is larger than one value; long values are grouped by digest.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.sources.files import family

MAX_CATEGORIES, SAMPLES = 50, 10
CATEGORY_RATIO, CATEGORY_FLOOR, CATEGORY_LENGTH = 0.2, 8, 64
ID_RATIO, DATE_SHARE = 0.95, 0.8
#: What a two-valued column holds to be boolean.
BOOLEAN_TOKENS = ("0", "1", "true", "false", "t", "f", "yes", "no", "y", "n")
SCALARS = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def looks_like_id(name: str) -> bool:
    """id, something_id, or somethingId."""
    low = name.lower()
    return low == "id" or low.endswith("_id") or len(name) > 2 and name.endswith("Id") and name[-3].isalnum() and not name[-3].isupper()


def normalize_type(name: str | None) -> str:
    """The family of a declared type name: exact names first, then parts of names; parameters don't count."""
    base = (name or "").split("(")[0].replace("[]", "").strip().lower()
    exact = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "float": "FLOAT", "double": "FLOAT", "real": "FLOAT", "numeric": "NUMERIC", "decimal": "NUMERIC", "money": "NUMERIC", "text": "TEXT", "string": "TEXT", "varchar": "TEXT", "char": "TEXT", "boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "datetime": "TIMESTAMP", "time": "TIME", "blob": "BLOB", "bytea": "BLOB", "binary": "BLOB", "json": "JSON", "jsonb": "JSON", "uuid": "UUID", "point": "OTHER", "interval": "OTHER", "xml": "OTHER", "array": "OTHER"}
    if base in exact:
        return exact[base]
    for part, kind in (("timestamp", "TIMESTAMP"), ("datetime", "TIMESTAMP"), ("date", "DATE"), ("interval", "OTHER"), ("point", "OTHER"), ("time", "TIME"), ("bool", "BOOLEAN"), ("int", "INTEGER"), ("serial", "INTEGER"), ("double", "FLOAT"), ("float", "FLOAT"), ("real", "FLOAT"), ("numeric", "NUMERIC"), ("decimal", "NUMERIC"), ("char", "TEXT"), ("text", "TEXT"), ("clob", "TEXT"), ("string", "TEXT"), ("blob", "BLOB"), ("binary", "BLOB"), ("json", "JSON"), ("uuid", "UUID")):
        if part in base:
            return kind
    return "OTHER" if base else "UNKNOWN"


def shown(name: str, t: T.DataType) -> Column:
    """A value as text, the same in every engine: dates and times to the day, fractions to cents."""
    c = F.col(f"`{name}`")
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return c.cast("decimal(28,2)").cast("string")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date").cast("string")
    return c.cast("string")


def columns_of(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, SCALARS)]


def long_form(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, value as text) of every scalar cell."""
    fields = [f for f in columns_of(df) if names is None or f.name in names]
    cells = F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in fields))
    return df.select(F.explode(cells).alias("x")).select("x.*")


#: Characters of a value beyond which distinct ones are counted by their digests, so that whole texts aren't moved.
LONG = 64
#: Relative error of the estimates of distinct values.
ERROR = 0.02


def _counts(df: DataFrame, estimate: bool = False) -> DataFrame:
    """One row per column: total, nulls, lo, hi, mean_len, date_share, boolean_like; with an estimate, distinct too."""
    fields = columns_of(df)
    aggregates = []
    for f in fields:
        c, text = F.col(f"`{f.name}`"), isinstance(f.dataType, T.StringType)
        show = lambda v, f=f: v.cast("decimal(28,2)").cast("string") if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else v.cast("date").cast("string") if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else v.cast("string")
        token = F.lower(F.trim(c.cast("string")))
        aggregates.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(family(f.dataType)).alias("family"),
                F.count(F.lit(1)).alias("total"),
                F.count_if(c.isNull()).alias("nulls"),
                show(F.min(c)).alias("lo"),
                show(F.max(c)).alias("hi"),
                (F.avg(F.length(c)) if text else F.lit(None).cast("double")).alias("mean_len"),
                (F.avg(F.when(c.isNotNull(), X.looks_like_date(c).cast("int"))) if text else F.lit(None).cast("double")).alias("date_share"),
                F.coalesce(F.every(token.isin(*BOOLEAN_TOKENS)), F.lit(False)).alias("boolean_like"),
                *([F.approx_count_distinct(c, ERROR).alias("distinct")] if estimate else []),
            ).alias(f.name)
        )
    return df.agg(*aggregates).select(F.explode(F.array(*(F.col(f"`{f.name}`") for f in fields))).alias("x")).select("x.*")


def profile(df: DataFrame, table: str, keys: tuple[str, ...] = (), refs: dict[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """(table, column, family, total, nulls, distinct, lo, hi, mean_len, role) of every scalar column."""
    if approximate:
        found = _counts(df, estimate=True)
    else:
        cells = long_form(df).where("value is not null").withColumn("value", F.when(F.length("value") > LONG, F.sha2("value", 256)).otherwise(F.col("value")))
        distinct = cells.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("distinct"))
        found = _counts(df).join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("long")))
    return _with_role(found, table, [f.name for f in columns_of(df)], keys, refs or {})


COLUMNS = ("table", "column", "family", "total", "nulls", "distinct", "lo", "hi", "mean_len", "role")


def _with_role(found: DataFrame, table: str, names: list[str], keys: tuple[str, ...], refs: dict[str, str]) -> DataFrame:
    flags = F.create_map(*(x for n in names for x in (F.lit(n), F.struct(F.lit(n in keys).alias("key"), F.lit(n in refs).alias("ref"), F.lit(looks_like_id(n)).alias("id_like")))))
    return found.withColumn("flag", flags[F.col("column")]).select(F.lit(table).alias("table"), *COLUMNS[1:-1], role_column().alias("role"))


#: Whether a text reads as a date, as `text.looks_like_date` has it; most texts end at the first test.
DATE_SQL = r"""CASE WHEN {c} RLIKE '^\\s*[0-9]{{4}}' THEN coalesce(try_to_date(CASE
 WHEN trim({c}) RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$' THEN substring(trim({c}), 1, 10)
 WHEN trim({c}) RLIKE '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$' THEN concat_ws('-', split_part(trim({c}), '/', 1), lpad(split_part(trim({c}), '/', 2), 2, '0'), lpad(split_part(trim({c}), '/', 3), 2, '0'))
 WHEN trim({c}) RLIKE '^(19|20)[0-9]{{6}}$' THEN concat_ws('-', substring(trim({c}), 1, 4), substring(trim({c}), 5, 2), substring(trim({c}), 7, 2)) END, 'yyyy-MM-dd') IS NOT NULL, false) ELSE false END"""
COUNTED = "`table` string, `column` string, family string, total bigint, nulls bigint, lo string, hi string, mean_len double, date_share double"


def _first_look(df: DataFrame, table: str) -> DataFrame:
    """COUNTED: a row for each column, from one aggregate that Spark compiles as a whole."""
    parts = []
    for f in columns_of(df):
        c, kind = f"`{f.name.replace('`', '``')}`", f.dataType
        show = "CAST(CAST({} AS DECIMAL(28,2)) AS STRING)" if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else "CAST(CAST({} AS DATE) AS STRING)" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "CAST({} AS STRING)"
        text = isinstance(kind, T.StringType)
        length, date = (f"avg(length({c}))", f"avg(CASE WHEN {c} IS NOT NULL THEN CAST({DATE_SQL.format(c=c)} AS INT) END)") if text else ("CAST(NULL AS DOUBLE)",) * 2
        quoted = f.name.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"named_struct('column', '{quoted}', 'family', '{family(kind)}', 'total', count(1), 'nulls', count_if({c} IS NULL), 'lo', {show.format(f'min({c})')}, 'hi', {show.format(f'max({c})')}, 'mean_len', {length}, 'date_share', {date})")
    return df.selectExpr(f"array({', '.join(parts)}) AS x").select(F.lit(table).alias("table"), F.explode("x").alias("x")).select("table", "x.*")


def survey(frames: dict[str, DataFrame], declared: dict[str, tuple[tuple[str, ...], dict[str, str]]]) -> tuple[list[Row], list[Row]]:
    """(profile rows, (table, column, value) rows) of several tables, in three jobs over all of them; declared: keys and references.

    A first look takes counts, ranges and lengths. Columns that it doesn't settle (short texts, numbers that may be flags or
    ids) get an estimate of their distinct values, and those of few values are read for what they hold, so nothing else is
    shuffled. All results are bounded by the number of columns. Distinct counts of columns that weren't read are estimates
    (relative error ERROR), or 0 where nothing depends on them.
    """
    spark = next(iter(frames.values())).sparkSession
    rows = reduce(DataFrame.unionByName, (_first_look(df, t) for t, df in frames.items())).collect()
    flag = lambda r: r["family"] in ("INTEGER", "NUMERIC", "FLOAT") and {r["lo"], r["hi"]} <= {"0", "1", "0.00", "1.00"}
    asked: dict[str, list[str]] = {t: [] for t in frames}
    for r in rows:
        keys, refs = declared.get(r["table"], ((), {}))
        short = r["family"] == "TEXT" and (r["mean_len"] or 0) <= CATEGORY_LENGTH and (r["date_share"] or 0) < DATE_SHARE
        if r["column"] not in keys and r["column"] not in refs and (short or flag(r) or looks_like_id(r["column"])):
            asked[r["table"]].append(r["column"])
    parts = [df.agg(*(F.approx_count_distinct(f"`{c}`", ERROR).alias(str(k)) for k, c in enumerate(asked[t]))).select(F.lit(t).alias("t"), F.array(*map(F.col, map(str, range(len(asked[t]))))).alias("n")) for t, df in frames.items() if asked[t]]
    rough = {(r["t"], c): n for r in (reduce(DataFrame.unionByName, parts).collect() if parts else []) for c, n in zip(asked[r["t"]], r["n"])}
    kinds = {(r["table"], r["column"]): r for r in rows}
    few = {k: n for k, n in rough.items() if 0 < n <= MAX_CATEGORIES * (1 + 5 * ERROR) and (kinds[k]["family"] == "TEXT" or flag(kinds[k]))}
    parts = [long_form(df, [c for own, c in few if own == t]).where("value is not null").distinct().select(F.lit(t).alias("table"), "column", "value") for t, df in frames.items() if any(own == t for own, _ in few)]
    values = reduce(DataFrame.unionByName, parts).collect() if parts else []
    held: dict[tuple[str, str], set[str]] = {}
    for v in values:
        held.setdefault((v["table"], v["column"]), set()).add(v["value"].strip().lower())
    exact = Counter((v["table"], v["column"]) for v in values)
    settled = []
    for r in rows:
        k = (r["table"], r["column"])
        settled.append((*r, exact.get(k, rough.get(k, 0)), bool(held.get(k)) and held[k] <= set(BOOLEAN_TOKENS)))
    profiled = []
    for t, df in frames.items():
        own = spark.createDataFrame([x for x in settled if x[0] == t], COUNTED + ", distinct bigint, boolean_like boolean")  # a row for each column
        profiled.append(_with_role(own, t, [f.name for f in columns_of(df)], *declared.get(t, ((), {}))))
    found = reduce(DataFrame.unionByName, profiled).collect()
    kept = {(r["table"], r["column"]) for r in found if r["role"] in ("CATEGORICAL", "BOOLEAN")}
    return found, [v for v in values if (v["table"], v["column"]) in kept]


def samples(df: DataFrame, n: int = SAMPLES, within: int = 2000) -> DataFrame:
    """(column, samples): the first n distinct values of each column, in scan order, of the first `within` rows."""
    head = df.limit(within).withColumn("__n", F.monotonically_increasing_id())
    cells = F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in columns_of(df)))
    first = head.select("__n", F.explode(cells).alias("x")).where("x.value is not null").groupBy("x.column", "x.value").agg(F.min("__n").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])  # at most `within` values
    return first.groupBy("column").agg(F.slice(ordered, 1, n).alias("samples"))


def family_from_values(value: Column) -> Column:
    """An aggregate: the family of text values as a whole. Whole numbers and fractions are fractions, dates and times are
    times; any other mix is unknown, as is a column without values."""
    v = F.trim(value)
    kind = (
        F.when(v.rlike(r"^[+-]?\d+$"), "INTEGER")
        .when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "FLOAT")
        .when(F.lower(v).isin("true", "false"), "BOOLEAN")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & X.looks_like_date(v), "DATE")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]") & X.looks_like_date(v), "TIMESTAMP")
        .otherwise("TEXT")
    )
    kinds = F.array_sort(F.collect_set(F.when(v.isNotNull() & (v != ""), kind)))
    numbers, times = F.array(F.lit("FLOAT"), F.lit("INTEGER")), F.array(F.lit("DATE"), F.lit("TIMESTAMP"))
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(kinds == numbers, "FLOAT").when(kinds == times, "TIMESTAMP").otherwise("UNKNOWN")


def role_column() -> Column:
    """ID, BOOLEAN, DATE, NUMERIC, CATEGORICAL, FREE_TEXT or UNKNOWN, in this order of precedence."""
    present = F.col("total") - F.col("nulls")
    ratio = F.when(present > 0, F.col("distinct") / present).otherwise(0.0)
    number = F.col("family").isin("INTEGER", "FLOAT", "NUMERIC")
    text = F.col("family") == "TEXT"
    limit = F.least(F.lit(MAX_CATEGORIES), F.greatest(F.lit(CATEGORY_FLOOR), F.floor(present * CATEGORY_RATIO)))
    category = (present > 0) & (F.col("distinct") > 0) & (F.col("distinct") < present) & (F.coalesce("mean_len", F.lit(0.0)) <= CATEGORY_LENGTH) & (F.col("distinct") <= limit)
    return (
        F.when(F.col("flag.key") | F.col("flag.ref"), "ID")
        .when(F.col("flag.id_like") & number & (present > 0) & (ratio >= ID_RATIO), "ID")
        .when((F.col("family") == "BOOLEAN") | ((F.col("distinct") == 2) & F.col("boolean_like")), "BOOLEAN")
        .when(F.col("family").isin("DATE", "TIMESTAMP") | (text & (F.coalesce("date_share", F.lit(0.0)) >= DATE_SHARE)), "DATE")
        .when(number, "NUMERIC")
        .when(text & category, "CATEGORICAL")
        .when(text, "FREE_TEXT")
        .otherwise("UNKNOWN")
    )


def categories(df: DataFrame, profiled: DataFrame) -> DataFrame:
    """(table, column, value) of the columns that are CATEGORICAL or BOOLEAN, at most MAX_CATEGORIES values each."""
    chosen = profiled.where(F.col("role").isin("CATEGORICAL", "BOOLEAN")).select("table", "column").collect()  # a row for each column
    if not chosen:
        return df.sparkSession.createDataFrame([], "`table` string, `column` string, value string")
    values = long_form(df, [r["column"] for r in chosen]).where("value is not null").distinct()
    return values.select(F.lit(chosen[0]["table"]).alias("table"), "column", "value")


def deterministic_sample(df: DataFrame, ordinal: str, n: int = 5000) -> DataFrame:
    """The n rows whose ordinal hashes lowest: the same rows every time."""
    mixed = (F.col(ordinal).cast("decimal(30,0)") * F.lit(2654435761).cast("decimal(12,0)")) % F.lit(4294967291).cast("decimal(12,0)")
    return df.orderBy(mixed, ordinal).limit(n)

"""Rows and schemas as citable chunks of text, with ids that depend on identity and not on content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import ConfigError
from lodestone.functions import text as X
from lodestone.sources.files import family

NULL_PHRASE, EMPTY_PHRASE, CUT = "not recorded", "empty", " …[truncated]"
UNIT = "\x1f"


@dataclass(frozen=True)
class ChunkConfig:
    max_chunk_tokens: int = 512
    overlap_tokens: int = 64
    max_field_tokens: int = 256
    max_columns: int | None = None
    skip_ids: bool = True
    rows: bool = True
    cards: bool = True
    max_rows: int | None = None

    def __post_init__(self):
        if self.overlap_tokens >= self.max_chunk_tokens:
            raise ConfigError("the overlap has to be smaller than the chunk")
        if not (self.rows or self.cards):
            raise ConfigError("neither rows nor cards are wanted")


def key_value(name: str, t: T.DataType) -> Column:
    """A key part as text: booleans 1 and 0, null a NUL, bytes in hex, whole numbers without a point."""
    c = F.col(f"`{name}`")
    if isinstance(t, T.BooleanType):
        shown = F.when(c, "1").otherwise("0")
    elif isinstance(t, T.BinaryType):
        shown = F.lower(F.hex(c))
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        shown = F.when(c == F.floor(c), F.floor(c).cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    elif isinstance(t, T.DecimalType):
        shown = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    else:
        shown = c.cast("string")
    return F.when(c.isNull(), "\x00").otherwise(shown)


def make_key(df: DataFrame, key: tuple[str, ...]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("|", *(key_value(k, types[k]) for k in key))


def chunk_id(source: Column, kind: str, table: str, key: Column, part: Column) -> Column:
    """The first 32 hex digits of a digest of what a chunk is, not of what it says."""
    return F.substring(F.sha2(F.concat_ws(UNIT, source, F.lit(kind), F.lit(table), key, part.cast("string")), 256), 1, 32)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def format_value(name: str, t: T.DataType) -> Column:
    """A cell as prose; never null."""
    c = F.col(f"`{name}`")
    if isinstance(t, T.BooleanType):
        shown = F.when(c, "yes").otherwise("no")
    elif isinstance(t, (T.DoubleType, T.FloatType)):  # cents, so that engines agree on the text
        shown = F.when(c == F.floor(c), F.floor(c).cast("decimal(38,0)").cast("string")).otherwise(c.cast("decimal(38,2)").cast("string"))
    elif isinstance(t, T.DecimalType):
        shown = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        shown = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(t, T.BinaryType):
        shown = F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes of binary data>"))
    elif isinstance(t, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ", NULL_PHRASE)
        shown = F.when(F.size(c) == 0, EMPTY_PHRASE).otherwise(inner)
    elif isinstance(t, (T.MapType, T.StructType)):
        shown = F.to_json(c)
    else:
        shown = F.when(F.trim(c.cast("string")) == "", EMPTY_PHRASE).otherwise(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), shown), F.lit(NULL_PHRASE))


def truncated(value: Column, limit: int) -> Column:
    """A value cut to so many tokens, the mark included. Short values are seen to fit without being split."""
    mark = len(CUT.split()) + 4
    return F.when((F.length(value) <= limit) | (X.count_tokens(value) <= limit), value).otherwise(F.concat(F.rtrim(X.truncate_tokens(value, max(1, limit - mark))), F.lit(CUT)))


def row_text(df: DataFrame, table: str, key: tuple[str, ...], roles: dict[str, str], refs: dict[str, str], config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The rows with pk, text, id_columns, date_min, date_max, lang. Keys and id columns that aren't references stay out of the prose."""
    skipped = [f.name for f in df.schema.fields if config.skip_ids and (f.name in key or roles.get(f.name) == "ID" and f.name not in refs)]
    told = [f for f in df.schema.fields if f.name not in skipped and not f.name.startswith("_")][: config.max_columns]
    ids = [f for f in df.schema.fields if f.name in skipped]
    pk = make_key(df, key) if key else F.col("_row_ordinal").cast("string") if "_row_ordinal" in df.columns else F.lit("")
    clauses = [F.concat(F.lit(f"{f.name} is "), truncated(format_value(f.name, f.dataType), config.max_field_tokens)) for f in told]
    head = F.concat(F.lit(f"{table} record"), F.when(pk != "", F.concat(F.lit(" "), pk)).otherwise(""), F.lit(": "))
    text = F.concat(head, F.concat_ws("; ", *clauses), F.lit("."))
    dates = [F.col(f"`{f.name}`").cast("string") if family(f.dataType) == "TEXT" else F.date_format(f.name, "yyyy-MM-dd") for f in df.schema.fields if roles.get(f.name) == "DATE"]
    span = F.array_compact(F.array(*dates)) if dates else F.array().cast("array<string>")
    id_map = F.map_filter(F.create_map(*(x for f in ids for x in (F.lit(f.name), F.when(F.col(f"`{f.name}`").isNotNull(), format_value(f.name, f.dataType))))), lambda k, v: v.isNotNull()) if ids else F.create_map().cast("map<string,string>")
    out = df.select(pk.alias("pk"), text.alias("text"), id_map.alias("id_columns"), F.array_min(span).alias("date_min"), F.array_max(span).alias("date_max"))
    return out.withColumn("lang", X.script_tag(F.col("text")))


def split(text: Column, limit: int, overlap: int) -> Column:
    """Overlapping parts of at most `limit` tokens as an array; an empty text is one empty part."""
    if overlap >= limit:
        raise ConfigError("the overlap has to be smaller than the chunk")
    found, stride = X.pieces(text), limit - overlap
    n = F.size(found)
    parts = F.when(n <= limit, 1).otherwise(F.ceil((n - limit) / F.lit(stride)).cast("int") + 1)
    # One element, so that the pieces are found once and not once for each part.
    cut = F.transform(F.array(F.struct(found.alias("p"), parts.alias("n"))), lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.array_join(F.slice(x["p"], i * stride + 1, limit), "")))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.element_at(cut, 1))


def row_chunks(rows: DataFrame, table: str, source_id: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Verbalised rows as chunks; all parts of a row refer to it."""
    parts = rows.select("*", split(F.col("text"), config.max_chunk_tokens, config.overlap_tokens).alias("__p")).select("*", F.size("__p").alias("n_parts"), F.posexplode("__p").alias("part_index", "part"))
    return parts.select(
        chunk_id(F.lit(source_id), "row", table, F.col("pk"), F.col("part_index")).alias("chunk_id"),
        F.lit(source_id).alias("source_id"),
        F.lit("row").alias("kind"),
        F.lit(table).alias("table"),
        "pk",
        "part_index",
        "n_parts",
        F.col("part").alias("text"),
        content_hash(F.col("part")).alias("content_hash"),
        "lang",
    )


def _share(part: Column) -> Column:
    rounded = F.round(part * 100, 1)
    return F.when(part <= 0, "0%").when(part < 0.001, "<0.1%").when(rounded == F.floor(rounded), F.concat(F.floor(rounded).cast("string"), F.lit("%"))).otherwise(F.concat(rounded.cast("decimal(5,1)").cast("string"), F.lit("%")))


def schema_cards(profiled: DataFrame, categories: DataFrame, columns: DataFrame, source_id: str, max_categories: int = 12) -> DataFrame:
    """One card for each table. columns: (table, column, ord, type, is_key, nullable, ref)."""
    ranked = categories.groupBy("table", "column").agg(F.array_sort(F.collect_list("value")).alias("v"))  # at most 50 values each
    values = ranked.select("table", "column", F.concat(F.lit(" Values: "), F.array_join(F.slice("v", 1, max_categories), ", "), F.when(F.size("v") > max_categories, F.concat(F.lit(", and "), (F.size("v") - max_categories).cast("string"), F.lit(" more"))).otherwise(""), F.lit(".")).alias("values"))
    p = columns.join(profiled, ["table", "column"], "left").join(values, ["table", "column"], "left")
    bits = F.concat_ws(
        ", ",
        F.concat(F.lit("type "), F.col("type")),
        F.when(F.col("role") != "UNKNOWN", F.concat(F.lit("role "), F.lower("role"))),
        F.when(F.col("is_key"), "primary key"),
        F.when(F.col("nullable"), "nullable").otherwise("not nullable"),
        F.when(F.col("ref").isNotNull(), F.concat(F.lit("foreign key to "), F.col("ref"))),
        F.when(F.col("total") > 0, F.concat(F.col("distinct").cast("string"), F.lit(" distinct values, "), _share(F.col("nulls") / F.col("total")), F.lit(" missing"))),
        F.when(F.col("lo").isNotNull(), F.concat(F.lit("ranges from "), F.col("lo"), F.lit(" to "), F.col("hi"))),
        F.when(F.col("mean_len").isNotNull(), F.concat(F.lit("average length "), F.round("mean_len").cast("long").cast("string"), F.lit(" characters"))),
    )
    lines = p.select("table", "ord", "column", "is_key", "ref", "total", F.concat(F.lit("- "), F.col("column"), F.lit(": "), bits, F.lit("."), F.coalesce("values", F.lit(""))).alias("line"))
    grouped = lines.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ord", "column", "line", "is_key", "ref"))).alias("c"), F.max("total").alias("n"))
    names = F.transform("c", lambda x: x["column"])
    keys = F.transform(F.filter("c", lambda x: x["is_key"]), lambda x: x["column"])
    refs = F.transform(F.filter("c", lambda x: x["ref"].isNotNull()), lambda x: F.concat(F.col("table"), F.lit("."), x["column"], F.lit(" references "), x["ref"]))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Schema card for table "), F.col("table"), F.lit(". The "), F.col("table"), F.lit(" table has "), F.size("c").cast("string"), F.lit(" columns and "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" rows.")),
        F.concat(F.lit("Columns of "), F.col("table"), F.lit(": "), F.array_join(names, ", "), F.lit(".")),
        F.when(F.size(keys) > 0, F.concat(F.lit("Primary key: "), F.array_join(keys, ", "), F.lit("."))).otherwise("Primary key: none declared."),
        F.lit("Column details:"),
        F.array_join(F.transform("c", lambda x: x["line"]), "\n"),
        F.concat(F.lit("Foreign keys: "), F.when(F.size(refs) > 0, F.array_join(refs, "; ")).otherwise("none"), F.lit(".")),
    )
    cards = grouped.select("table", text.alias("text"))
    return cards.select(
        F.substring(F.sha2(F.concat_ws(UNIT, F.lit(source_id), F.lit("schema_card"), F.col("table"), F.lit(""), F.lit("0")), 256), 1, 32).alias("chunk_id"),
        F.lit(source_id).alias("source_id"), F.lit("schema_card").alias("kind"), "table", F.lit("").alias("pk"), F.lit(0).alias("part_index"), F.lit(1).alias("n_parts"), "text", content_hash(F.col("text")).alias("content_hash"), X.script_tag(F.col("text")).alias("lang"),
    )

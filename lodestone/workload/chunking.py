"""Rows and schemas as chunks; tokens; parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import text as X
from lodestone.operators import chunks as C
from lodestone.sources.catalog import Catalog

SOURCE = "parquet"
LIMIT, OVERLAP = 200, 40


def _roles(engine: Engine, tables: list[str]) -> dict:
    out: dict = {}
    for r in engine.profiles(tables)[0].select("table", "column", "role").collect():
        out.setdefault(r["table"], {})[r["column"]] = r["role"]
    return out


def rows_of(table: str):
    def run(spark, directory):
        catalog = Catalog(spark, directory)
        own = catalog.table(table)
        text = C.row_text(catalog.load(table), table, own.key, _roles(Engine(catalog), [table]).get(table, {}), own.refs)
        return C.row_chunks(text, table, SOURCE).select("chunk_id", "pk", "text", "content_hash", "lang")

    return run


def ids_hash(spark, directory):
    rows = Catalog(spark, directory).load("orders")
    pk = C.make_key(rows, ("o_orderkey",))
    return rows.select(C.chunk_id(F.lit(SOURCE), "row", "orders", pk, F.lit(0)).alias("chunk_id"), C.content_hash(F.col("o_orderpriority")).alias("content_hash"))


def split(spark, directory):
    docs = Catalog(spark, directory).load("documents")
    parts = C.split(F.col("text"), LIMIT, OVERLAP)
    return docs.select("doc_id", parts.alias("p")).select("doc_id", F.size("p").cast("long").alias("n_parts"), F.posexplode("p").alias("part_index", "part")).select("doc_id", F.col("part_index").cast("long").alias("part_index"), "n_parts", F.sha2("part", 256).alias("part_hash"))


def cards(spark, directory):
    return Engine(Catalog(spark, directory)).chunk(["region", "nation", "customer"], C.ChunkConfig(rows=False)).select("table", "text")


def truncation(spark, directory):
    docs = Catalog(spark, directory).load("documents")
    return docs.select("doc_id", F.sha2(X.truncate_tokens(F.col("text"), 50), 256).alias("head_hash"))


def token_counts(spark, directory):
    return Catalog(spark, directory).load("documents").select("doc_id", X.count_tokens(F.col("text")).cast("long").alias("n_tokens"))


def lang_tags(spark, directory):
    return Catalog(spark, directory).load("documents").select("doc_id", X.script_tag(F.col("text")).alias("tag"))


def dates(spark, directory):
    """The first and last date of each row that has some."""
    catalog = Catalog(spark, directory)
    own = catalog.table("orders")
    return C.row_text(catalog.load("orders"), "orders", own.key, {"o_orderdate": "DATE"}, own.refs).select("pk", "date_min", "date_max")


def ingest_counts(spark, directory):
    """What a first ingest makes, by table and kind."""
    engine = Engine(Catalog(spark, directory))
    made = engine.chunk(["region", "nation", "customer", "supplier"])
    return made.groupBy("table", "kind").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))


#: The tokenizer's pattern for an engine whose \s and \d are of ASCII.
PIECE = r"[\t\n\v\f\r \x{85}\p{Z}]{24}|[\t\n\v\f\r \x{85}\p{Z}]{0,23}(?:[A-Za-z]{1,24}|\p{Nd}{1,24}|[\x{600}-\x{6FF}]{1,24}|[\x{4E00}-\x{9FFF}]|[^\t\n\v\f\r \x{85}\p{Z}A-Za-z\p{Nd}])|[\t\n\v\f\r \x{85}\p{Z}]+"
PIECES = f"regexp_extract_all(text, '{PIECE}')"


def _id(table: str, pk: str, part: str = "0") -> str:
    return f"substr(sha256('{SOURCE}' || chr(31) || 'row' || chr(31) || '{table}' || chr(31) || {pk} || chr(31) || '{part}'), 1, 32)"


def _chunks_sql(table: str, pk: str, text: str) -> str:
    return f"SELECT {_id(table, 'pk')} AS chunk_id, pk, text, sha256(text) AS content_hash, 'en' AS lang FROM (SELECT {pk} AS pk, {text} AS text FROM {table})"


CARD = """
WITH c("table", ord, col, type, role, is_key, ref, n, d, lo, hi, len, vals) AS (
  SELECT 'region', 0, 'r_regionkey', 'int', 'id', true, NULL, count(*), count(DISTINCT r_regionkey), min(r_regionkey)::VARCHAR, max(r_regionkey)::VARCHAR, NULL, NULL FROM region UNION ALL
  SELECT 'region', 1, 'r_name', 'string', 'free_text', false, NULL, count(*), count(DISTINCT r_name), min(r_name), max(r_name), avg(length(r_name)), NULL FROM region UNION ALL
  SELECT 'nation', 0, 'n_nationkey', 'int', 'id', true, NULL, count(*), count(DISTINCT n_nationkey), min(n_nationkey)::VARCHAR, max(n_nationkey)::VARCHAR, NULL, NULL FROM nation UNION ALL
  SELECT 'nation', 1, 'n_name', 'string', 'free_text', false, NULL, count(*), count(DISTINCT n_name), min(n_name), max(n_name), avg(length(n_name)), NULL FROM nation UNION ALL
  SELECT 'nation', 2, 'n_regionkey', 'int', 'id', false, 'region.r_regionkey', count(*), count(DISTINCT n_regionkey), min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR, NULL, NULL FROM nation UNION ALL
  SELECT 'customer', 0, 'c_custkey', 'bigint', 'id', true, NULL, count(*), count(DISTINCT c_custkey), min(c_custkey)::VARCHAR, max(c_custkey)::VARCHAR, NULL, NULL FROM customer UNION ALL
  SELECT 'customer', 1, 'c_name', 'string', 'free_text', false, NULL, count(*), count(DISTINCT c_name), min(c_name), max(c_name), avg(length(c_name)), NULL FROM customer UNION ALL
  SELECT 'customer', 2, 'c_nationkey', 'int', 'id', false, 'nation.n_nationkey', count(*), count(DISTINCT c_nationkey), min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR, NULL, NULL FROM customer UNION ALL
  SELECT 'customer', 3, 'c_acctbal', 'double', 'numeric', false, NULL, count(*), count(DISTINCT c_acctbal), min(c_acctbal)::DECIMAL(28,2)::VARCHAR, max(c_acctbal)::DECIMAL(28,2)::VARCHAR, NULL, NULL FROM customer UNION ALL
  SELECT 'customer', 4, 'c_mktsegment', 'string', 'categorical', false, NULL, count(*), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment), avg(length(c_mktsegment)), string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) FROM customer),
l AS (SELECT *, '- ' || col || ': type ' || type || ', role ' || role || CASE WHEN is_key THEN ', primary key, not nullable' ELSE ', nullable' END || coalesce(', foreign key to ' || ref, '') || ', ' || d || ' distinct values, 0% missing, ranges from ' || lo || ' to ' || hi || coalesce(', average length ' || round(len)::BIGINT || ' characters', '') || '.' || coalesce(' Values: ' || vals || '.', '') AS line FROM c)
SELECT "table", 'Schema card for table ' || "table" || '. The ' || "table" || ' table has ' || count(*) || ' columns and ' || max(n) || ' rows.' || chr(10) || 'Columns of ' || "table" || ': ' || string_agg(col, ', ' ORDER BY ord) || '.' || chr(10) || 'Primary key: ' || string_agg(col, ', ' ORDER BY ord) FILTER (is_key) || '.' || chr(10) || 'Column details:' || chr(10) || string_agg(line, chr(10) ORDER BY ord) || chr(10) || 'Foreign keys: ' || coalesce(string_agg("table" || '.' || col || ' references ' || ref, '; ' ORDER BY ord) FILTER (ref IS NOT NULL), 'none') || '.' AS text FROM l GROUP BY "table"
"""
MONEY = "CASE WHEN {0} = floor({0}) THEN floor({0})::BIGINT::VARCHAR ELSE {0}::DECIMAL(38,2)::VARCHAR END"

QUERIES = {
    "chunk_rows_nation": (rows_of("nation"), _chunks_sql("nation", "n_nationkey::VARCHAR", "'nation record ' || n_nationkey || ': n_name is ' || n_name || '; n_regionkey is ' || n_regionkey || '.'")),
    "chunk_rows_customer": (rows_of("customer"), _chunks_sql("customer", "c_custkey::VARCHAR", f"'customer record ' || c_custkey || ': c_name is ' || c_name || '; c_nationkey is ' || c_nationkey || '; c_acctbal is ' || {MONEY.format('c_acctbal')} || '; c_mktsegment is ' || c_mktsegment || '.'")),
    "chunk_rows_orders": (rows_of("orders"), _chunks_sql("orders", "o_orderkey::VARCHAR", f"'orders record ' || o_orderkey || ': o_custkey is ' || o_custkey || '; o_orderstatus is ' || o_orderstatus || '; o_totalprice is ' || {MONEY.format('o_totalprice')} || '; o_orderdate is ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '; o_orderpriority is ' || o_orderpriority || '.'")),
    "chunk_ids_hash": (ids_hash, f"SELECT {_id('orders', 'o_orderkey::VARCHAR')} AS chunk_id, sha256(o_orderpriority) AS content_hash FROM orders"),
    "chunk_split_overlap": (split, f"WITH t AS (SELECT doc_id, text, {PIECES} AS p FROM documents), n AS (SELECT *, CASE WHEN len(p) <= {LIMIT} THEN 1 ELSE ceil((len(p) - {LIMIT}) / {LIMIT - OVERLAP}.0)::BIGINT + 1 END AS k FROM t), u AS (SELECT *, unnest(range(k)) AS i FROM n) SELECT doc_id, i AS part_index, k AS n_parts, sha256(CASE WHEN k = 1 THEN text ELSE array_to_string(p[i * {LIMIT - OVERLAP} + 1 : i * {LIMIT - OVERLAP} + {LIMIT}], '') END) AS part_hash FROM u"),
    "schema_cards": (cards, CARD),
    "token_truncate": (truncation, f"SELECT doc_id, sha256(array_to_string({PIECES}[1:50], '')) AS head_hash FROM documents"),
    "token_counts": (token_counts, f"SELECT doc_id, len({PIECES})::BIGINT AS n_tokens FROM documents"),
    "lang_tag": (lang_tags, r"SELECT doc_id, CASE WHEN a AND l THEN 'mixed' WHEN a THEN 'ar' ELSE 'en' END AS tag FROM (SELECT doc_id, regexp_matches(text, '[\x{0600}-\x{06FF}]') AS a, regexp_matches(text, '[A-Za-z]') AS l FROM documents)"),
    "row_dates": (dates, "SELECT o_orderkey::VARCHAR AS pk, o_orderdate::DATE::VARCHAR AS date_min, o_orderdate::DATE::VARCHAR AS date_max FROM orders"),
    "ingest_counts": (ingest_counts, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", 'row' AS kind, count(*) AS n, count(*) AS ids FROM {t} UNION ALL SELECT '{t}', 'schema_card', 1, 1" for t in ("region", "nation", "customer", "supplier"))),
}

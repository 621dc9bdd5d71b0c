"""Profiles, roles, vocabularies and samples of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import profile as P
from lodestone.sources.catalog import Catalog, with_ordinal

#: (table, column, kind) of the tables profiled against SQL; t text, i whole number, d fraction, s time.
COLUMNS = [
    (t, c, k)
    for t, cols in {
        "region": "r_regionkey:i r_name:t",
        "nation": "n_nationkey:i n_name:t n_regionkey:i",
        "customer": "c_custkey:i c_name:t c_nationkey:i c_acctbal:d c_mktsegment:t",
        "supplier": "s_suppkey:i s_name:t s_nationkey:i s_acctbal:d",
        "part": "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:d",
        "orders": "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:d o_orderdate:s o_orderpriority:t",
        "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:t l_linestatus:t l_shipdate:s",
        "events": "event_id:i ts:s user_id:i event_type:t value:d props:t",
        "documents": "doc_id:i text:t lang:t source:t n_chars:i",
        "labels": "doc_id:i quality:i toxic:i",
        "pages": "page_id:i url:t html:t",
        "benchmark": "item_id:i text:t",
        "conversations": "conv_id:i turn:i role:t text:t",
    }.items()
    for c, k in (x.split(":") for x in cols.split())
]
TABLES = list(dict.fromkeys(t for t, _, _ in COLUMNS))


def profiles(spark, directory):
    catalog = Catalog(spark, directory)
    out = None
    for t in TABLES:
        own = catalog.table(t)
        p = P.profile(catalog.load(t), t, own.key, own.refs)
        out = p if out is None else out.unionByName(p)
    return out


def columns(spark, directory):
    return profiles(spark, directory).select("table", "column", "total", "nulls", "distinct", "lo", "hi", F.round("mean_len", 4).alias("mean_len"))


def roles(spark, directory):
    return profiles(spark, directory).select("table", "column", "role")


def vocabularies(spark, directory):
    """From a survey: only values of columns that have few are shuffled, and the values themselves tell which those are."""
    catalog = Catalog(spark, directory)
    named = ("customer", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")
    _, values = P.survey({t: catalog.load(t) for t in named}, {t: (catalog.table(t).key, catalog.table(t).refs) for t in named})
    out = spark.createDataFrame(values, "`table` string, `column` string, value string")  # at most MAX_CATEGORIES for a column
    return out.groupBy("table", "column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("categories"))


def sample(spark, directory):
    rows = Catalog(spark, directory).load("orders")
    return P.deterministic_sample(rows, "o_orderkey", 500).select("o_orderkey")


def date_shares(spark, directory):
    """How much of text columns reads as dates, over values of several kinds."""
    orders = Catalog(spark, directory).load("orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    values = {"iso": iso, "slash": F.date_format("o_orderdate", "yyyy/M/d"), "compact": F.date_format("o_orderdate", "yyyyMMdd"), "number": F.col("o_orderkey").cast("string"), "word": F.col("o_orderpriority")}
    forms = F.array(*(F.struct(F.lit(k).alias("form"), v.alias("v")) for k, v in values.items()))
    return orders.select(F.explode(forms).alias("x")).groupBy("x.form").agg(F.round(F.avg(X.looks_like_date(F.col("x.v")).cast("int")), 6).alias("share"))


def key_strings(spark, directory):
    from lodestone.operators.chunks import make_key

    rows = Catalog(spark, directory).load("conversations")
    return rows.select(make_key(rows, ("conv_id", "turn")).alias("pk"), F.length("text").cast("long").alias("n"))


def approximate(spark, directory):
    """Distinct counts by sketch next to exact ones, as the share they're off by."""
    catalog = Catalog(spark, directory)
    exact = P.profile(catalog.load("orders"), "orders").select("column", F.col("distinct").alias("exact"))
    rough = P.profile(catalog.load("orders"), "orders", approximate=True).select("column", F.col("distinct").alias("rough"))
    return exact.join(rough, "column").select("column", (F.abs(F.col("rough") - F.col("exact")) <= F.greatest(F.lit(2), F.col("exact") * 0.15)).alias("close"))


def _column_sql(t: str, c: str, k: str) -> str:
    show = {"t": "{}", "i": "{}::VARCHAR", "d": "{}::DECIMAL(28,2)::VARCHAR", "s": "{}::DATE::VARCHAR"}[k]
    length = f"round(avg(length({c})), 4)" if k == "t" else "NULL::DOUBLE"
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", {show.format(f'min({c})')} AS lo, {show.format(f'max({c})')} AS hi, {length} AS mean_len FROM {t}"


COLUMNS_SQL = " UNION ALL ".join(_column_sql(*x) for x in COLUMNS)


def _roles_sql() -> str:
    keyed = "region.r_regionkey nation.n_nationkey nation.n_regionkey customer.c_custkey customer.c_nationkey supplier.s_suppkey supplier.s_nationkey part.p_partkey orders.o_orderkey orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey events.event_id documents.doc_id labels.doc_id pages.page_id benchmark.item_id conversations.conv_id conversations.turn".split()
    parts = []
    for t, c, k in COLUMNS:
        family = {"t": "TEXT", "i": "NUMBER", "d": "NUMBER", "s": "DATE"}[k]
        token = "coalesce(bool_and(lower(trim({0}::VARCHAR)) IN ('0','1','true','false','t','f','yes','no','y','n')), false)".format(c)
        length = f"avg(length({c}))" if k == "t" else "NULL::DOUBLE"
        parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{family}' AS fam, {f'{t}.{c}' in keyed} AS declared, ('{c}' = 'id' OR '{c}' LIKE '%\\_id' ESCAPE '\\') AS id_like, count({c}) AS n, count(DISTINCT {c}) AS d, {length} AS len, {token} AS tok FROM {t}")
    body = " UNION ALL ".join(parts)
    return f"""SELECT "table", "column", CASE WHEN declared THEN 'ID' WHEN id_like AND fam = 'NUMBER' AND n > 0 AND d / n >= 0.95 THEN 'ID' WHEN d = 2 AND tok THEN 'BOOLEAN' WHEN fam = 'DATE' THEN 'DATE' WHEN fam = 'NUMBER' THEN 'NUMERIC'
 WHEN d > 0 AND d < n AND len <= 64 AND d <= least(50, greatest(8, floor(0.2 * n))) THEN 'CATEGORICAL' ELSE 'FREE_TEXT' END AS role FROM ({body})"""


QUERIES = {
    "profile_columns": (columns, COLUMNS_SQL),
    "profile_roles": (roles, _roles_sql()),
    "profile_categories": (vocabularies, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", string_agg(v, '|' ORDER BY v) AS categories FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {t})" for t, c in (("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("events", "event_type"), ("documents", "lang"), ("documents", "source"), ("labels", "quality"), ("labels", "toxic"), ("conversations", "role")))),
    "profile_sample_deterministic": (sample, "SELECT o_orderkey FROM orders ORDER BY (o_orderkey::HUGEINT * 2654435761) % 4294967291, o_orderkey LIMIT 500"),
    "date_parse_share": (date_shares, "SELECT form, round(avg(ok), 6) AS share FROM (SELECT 'iso' AS form, 1 AS ok FROM orders UNION ALL SELECT 'slash', 1 FROM orders UNION ALL SELECT 'compact', 1 FROM orders UNION ALL SELECT 'number', 0 FROM orders UNION ALL SELECT 'word', 0 FROM orders) GROUP BY form"),
    "pk_strings": (key_strings, "SELECT conv_id::VARCHAR || '|' || turn::VARCHAR AS pk, length(text) AS n FROM conversations"),
    "profile_approximate": (approximate, "SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS \"column\", true AS close"),
}

"""Questions answered by one planned aggregate, from the question's words to a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.engine import Engine, flagship
from lodestone.plans import planner
from lodestone.plans.guard import guard
from lodestone.plans.lexicon import Lexicon
from lodestone.sources.catalog import Catalog, with_ordinal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


_ENGINES: dict = {}


def engine(spark, directory: str) -> Engine:
    """The engine of a directory, as an application would hold it. It reads its words again whenever the files change."""
    if _ENGINES.get("for") != (id(spark), directory):
        _ENGINES.update({"for": (id(spark), directory), "engine": Engine(Catalog(spark, directory))})
    return _ENGINES["engine"]


def lexicon(spark, directory: str) -> Lexicon:
    """The words of the star schema."""
    return engine(spark, directory).lexicon(TABLES)


def asked(question: str, digits: int | None = None):
    """A query that plans the question, checks its SQL with the guard, and returns the planned frame."""

    def run(spark, directory):
        lex = lexicon(spark, directory)
        p = planner.plan(question, lex)
        guard(spark, planner.to_sql(p), set(p.tables()))
        df = planner.to_frame(p, lex)
        return df if digits is None else df.withColumn("value", F.round("value", digits))

    return run


def row_counts(spark, directory):
    catalog = Catalog(spark, directory)
    out = None
    for t in catalog.tables():
        n = catalog.load(t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def ordered_scan(spark, directory):
    """All rows of a table without a key, by their place in the file."""
    rows = with_ordinal(Catalog(spark, directory).load("lineitem"))
    return rows.select(F.col("_row_ordinal").alias("n"), "l_orderkey", "l_linenumber", "l_quantity")


def readonly(spark, directory):
    from lodestone.plans.guard import execute_readonly

    Catalog(spark, directory).load("nation").createOrReplaceTempView("nation")
    found = execute_readonly(spark, "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1 ORDER BY n_name;", 3, {"nation"})
    return spark.createDataFrame([(*r, found.truncated) for r in found.rows], "n_name string, n_regionkey int, truncated boolean")


SPANS = [(0, "2030-01-01", "2030-12-31"), (1, "1995-03-01", "1995-06-30"), (2, "2024-01-05", "2024-01-06"), (3, "1900-01-01", "1994-12-31"), (4, "1994-12-31", "1995-01-01"), (5, "2024-02-15", "2025-01-01")]


def outside(spark, directory):
    """Whether date ranges miss all dates of orders and of events, as the engine's lexicon sees it."""
    lex = Engine(Catalog(spark, directory)).lexicon(["orders", "events"])
    return spark.createDataFrame([(q, lex.outside_data(lo, hi)) for q, lo, hi in SPANS], "qid int, is_outside boolean")


def lexicon_values(spark, directory):
    from lodestone.plans.lexicon import lexicon_table

    return lexicon_table(lexicon(spark, directory), spark).where("kind = 'value'").select("form", "table", "column", "value")


def categorical_sql() -> str:
    """Every value of the categorical columns of the star schema, tokenised as questions are."""
    parts = []
    for t, c in (("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus")):
        parts.append(f"SELECT DISTINCT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM {t}")
    return "SELECT trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS form, \"table\", \"column\", value FROM (" + " UNION ALL ".join(parts) + ")"


#: (question, route, SQL of the value or None if it has to be refused)
SET = [
    ("How many orders have the status 'F'?", "aggregate", "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'"),
    ("How many orders were placed by customers in the BUILDING segment?", "hybrid", "SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    ("How many orders were placed in March 1996?", "aggregate", "SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'"),
    ("How many orders were placed after 1996-01-01?", "aggregate", "SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-02'"),
    ("How many parts of brand Brand#3 have the type PROMO?", "aggregate", "SELECT count(*) FROM part WHERE p_brand = 'Brand#3' AND p_type = 'PROMO'"),
    ("How many customers are in the MACHINERY segment?", "aggregate", "SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    ("Number of line items with return flag 'R'", "aggregate", "SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'"),
    ("How many orders are there?", "aggregate", "SELECT count(*) FROM orders"),
    ("How many orders were placed by customers in the BUILDING segment before 1990-01-01?", "hybrid", None),
    ("How many orders have the status 'LOST'?", "aggregate", None),
    ("What is the phone number of customer 7?", "aggregate", None),
    ("How many warehouses are there?", "aggregate", None),
    ("How many orders were placed between 2030-01-01 and 2030-12-31?", "aggregate", None),
    ("How many orders were placed in the first half of 1996?", "aggregate", None),
]


def ask_batch(spark, directory):
    """A question set through the engine: routed, planned, guarded, computed or refused."""
    e = engine(spark, directory)
    e.lexicon(TABLES)
    return e.ask_batch([q for q, _, _ in SET]).select("qid", "value", "refused")


def route_questions(spark, directory):
    """The routes of the question set, of schema questions and of look-ups, over the words of the star schema."""
    lex = lexicon(spark, directory)
    return spark.createDataFrame([(n, planner.classify(q, lex).name) for n, (q, _) in enumerate(ROUTED)], "qid int, route string")


ROUTED = [(q, r) for q, r, v in SET if v] + [
    ("What columns does the orders table have?", "lookup"), ("Describe the schema of part", "lookup"), ("Tell me about customer 7", "lookup"), ("supplier 12", "lookup"),
    ("Which customers ordered parts?", "hybrid"), ("What is the average retail price of parts?", "aggregate"), ("Total quantity of line items per return flag", "aggregate"), ("the largest part", "aggregate"), ("", "lookup"),
]

DAY = "o_orderdate >= TIMESTAMP '{}' AND o_orderdate < TIMESTAMP '{}'"

QUERIES = {
    "ask_orders_1995": (lambda s, d: flagship(s, d).select("qid", "route", "value", "refused"), f"SELECT 0::INT AS qid, 'aggregate' AS route, count(*) AS value, false AS refused FROM orders WHERE {DAY.format('1995-01-01', '1996-01-01')}"),
    "row_counts": (row_counts, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split())),
    "ordered_scan": (ordered_scan, "SELECT file_row_number AS n, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM lineitem)"),
    "execute_readonly": (readonly, "SELECT n_name, n_regionkey, true AS truncated FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 3"),
    "agg_count_by_status": (asked("How many orders have the status 'F'?"), "SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'F'"),
    "agg_avg_filtered": (asked("What is the average account balance of customers in the BUILDING segment?", 4), "SELECT round(avg(c_acctbal), 4) AS value FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "agg_sum_filtered": (asked("What is the total retail price of parts with type PROMO?", 2), "SELECT round(sum(p_retailprice), 2) AS value FROM part WHERE p_type = 'PROMO'"),
    "agg_min_filtered": (asked("What is the lowest account balance of customers in the MACHINERY segment?"), "SELECT min(c_acctbal) AS value FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "agg_max_filtered": (asked("What is the highest retail price of parts of brand Brand#3?"), "SELECT max(p_retailprice) AS value FROM part WHERE p_brand = 'Brand#3'"),
    "agg_two_filters": (asked("How many parts of brand Brand#3 have the type PROMO?"), "SELECT count(*) AS value FROM part WHERE p_brand = 'Brand#3' AND p_type = 'PROMO'"),
    "agg_date_window": (asked("How many orders were placed between 1995-03-01 and 1995-06-30?"), f"SELECT count(*) AS value FROM orders WHERE {DAY.format('1995-03-01', '1995-07-01')}"),
    "agg_month_window": (asked("How many orders were placed in March 1996?"), f"SELECT count(*) AS value FROM orders WHERE {DAY.format('1996-03-01', '1996-04-01')}"),
    "agg_year_window": (asked("What is the total extended price of line items in 1996?", 0), "SELECT round(sum(l_extendedprice), 0) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'"),
    "agg_before": (asked("How many orders were placed before 1996-01-01?"), "SELECT count(*) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'"),
    "agg_after": (asked("How many orders were placed after 1996-01-01?"), "SELECT count(*) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-02'"),
    "agg_group_by": (asked("How many orders are there for each priority?"), "SELECT o_orderpriority, count(*) AS value FROM orders GROUP BY 1"),
    "agg_group_avg": (asked("What is the average quantity of line items per return flag?", 4), "SELECT l_returnflag, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1"),
    "agg_fk_join": (asked("How many orders were placed by customers in the BUILDING segment?"), "SELECT count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "agg_fk_join_group": (asked("How many orders were placed for each market segment?"), "SELECT c_mktsegment, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "agg_two_hop_join": (asked("What is the total quantity of line items of customers in the AUTOMOBILE segment?", 2), "SELECT round(sum(l_quantity), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE'"),
    "date_range_guard": (outside, "WITH r AS (SELECT min(o_orderdate)::DATE::VARCHAR a, max(o_orderdate)::DATE::VARCHAR b FROM orders UNION ALL SELECT min(ts)::DATE::VARCHAR, max(ts)::DATE::VARCHAR FROM events), q(qid, lo, hi) AS (VALUES (0, '2030-01-01', '2030-12-31'), (1, '1995-03-01', '1995-06-30'), (2, '2024-01-05', '2024-01-06'), (3, '1900-01-01', '1994-12-31'), (4, '1994-12-31', '1995-01-01'), (5, '2024-02-15', '2025-01-01')) SELECT qid::INT AS qid, bool_and(hi < a OR lo > b) AS is_outside FROM q, r GROUP BY qid"),
    "lexicon_values": (lexicon_values, categorical_sql()),
    "ask_batch": (ask_batch, " UNION ALL ".join(f"SELECT {n}::INT AS qid, {f'({v})::VARCHAR' if v else 'NULL::VARCHAR'} AS value, {'false' if v else 'true'} AS refused" for n, (_, _, v) in enumerate(SET))),
    "route_questions": (route_questions, " UNION ALL ".join(f"SELECT {n}::INT AS qid, '{r}' AS route" for n, (_, r) in enumerate(ROUTED))),
}

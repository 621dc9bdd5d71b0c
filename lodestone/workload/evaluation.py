"""Metrics over hits with gold keys, and over results made from the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluate as V
from lodestone.operators import scan as S
from lodestone.operators.stage import staged
from lodestone.sources.catalog import Catalog
from lodestone.workload import retrieval as R
from lodestone.workload.retrieval import BASE


def metrics(spark, directory):
    """Hits are the ten best documents; gold is the two best English ones and a document that isn't there."""
    words = R.counted(spark, directory)
    hits = S.bm25(words, R.K).select("qid", F.col("chunk_id").alias("key"), "rank")
    best = staged(S.bm25(words, 2, R.ENGLISH).select("qid", F.col("chunk_id").alias("key")))
    missing = R.questions(spark, directory).select("qid", F.lit(-1).cast("long").alias("key"))
    return V.retrieval(hits, best.unionByName(missing))


def results(spark, directory):
    """A result for every order: what was asked, expected, predicted and cited."""
    o, k = Catalog(spark, directory).load("orders"), F.col("o_orderkey")
    routes = lambda n: F.when(k % n == 0, "lookup").when(k % n == 1, "aggregate").otherwise("hybrid")
    return o.select(
        F.col("o_orderpriority").alias("qtype"), (k % 5 != 0).alias("answerable"), (k % 7 == 0).alias("refused"), (k % 97 == 0).alias("crashed"),
        routes(3).alias("expected_route"), routes(4).alias("route"), (k % 2 == 0).alias("correct"), (k % 11 != 0).alias("used_sql"),
        F.col("o_totalprice").alias("gold"), (F.col("o_totalprice") * (1 + F.when(k % 3 == 0, 1e-3).when(k % 3 == 1, 1e-8).otherwise(0.0))).alias("predicted"),
    )


def aggregate_accuracy(spark, directory):
    r = results(spark, directory)
    ok = V.scalar_correct(F.when(F.col("refused"), None).otherwise(F.col("predicted")), F.col("gold"), F.lit("float"))
    return r.groupBy("qtype").agg(F.round(F.avg(ok.cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def rates(spark, directory):
    return V.summary(results(spark, directory))


def confusion(spark, directory):
    return V.confusion(results(spark, directory))


def citations(spark, directory):
    o = Catalog(spark, directory).load("lineitem")
    cited = o.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("key"))
    gold = o.where("l_linenumber >= 3").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("key"))
    return V.citation_scores(cited, gold)


def stratified(spark, directory):
    return V.stratified_sample(R.documents(spark, directory).select("chunk_id", "lang"), "lang", "chunk_id", 25).select("chunk_id", "lang")


def gold_by_type(spark, directory):
    """Gold values as a filter and an aggregate give them, nulls left out."""
    o = Catalog(spark, directory).load("orders")
    some = o.withColumn("x", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    return some.groupBy("o_orderstatus").agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))


def comparison(spark, directory):
    """Rates of the first and the second half of the results, side by side."""
    r = results(spark, directory).withColumn("half", F.col("gold") > 200000)
    return V.compare(V.summary(r.where("not half")).select("qtype", "n", "router_accuracy"), V.summary(r.where("half")).select("qtype", "n", "router_accuracy")).select("qtype", "n_a", "n_b", "n_change", F.round("router_accuracy_change", 6).alias("accuracy_change"))


ROUTE = "CASE o_orderkey % {0} WHEN 0 THEN 'lookup' WHEN 1 THEN 'aggregate' ELSE 'hybrid' END"
RESULTS = f"r AS (SELECT o_orderpriority AS qtype, o_orderkey % 5 <> 0 AS answerable, o_orderkey % 7 = 0 AS refused, o_orderkey % 97 = 0 AS crashed, {ROUTE.format(3)} AS er, {ROUTE.format(4)} AS route, o_orderkey % 2 = 0 AS correct, o_orderkey % 11 <> 0 AS used, o_totalprice AS gold, o_totalprice * (1 + CASE o_orderkey % 3 WHEN 0 THEN 1e-3 WHEN 1 THEN 1e-8 ELSE 0 END) AS pred FROM orders)"
RATE = "round(count(*) FILTER ({0} AND {1})::DOUBLE / nullif(count(*) FILTER ({1}), 0), 6) AS {2}"
RATES = ", ".join(
    RATE.format(*x)
    for x in (
        ("NOT refused AND NOT crashed", "NOT answerable", "false_answer_rate"), ("refused AND NOT crashed", "NOT answerable", "refusal_rate"), ("refused AND NOT crashed", "answerable", "false_refusal_rate"),
        ("route = er", "true", "router_accuracy"), ("correct", "er <> 'lookup'", "aggregate_accuracy"), ("used", "er <> 'lookup'", "sql_coverage"),
    )
)
HALF = f"(SELECT qtype, count(*) AS n, {RATE.format('route = er', 'true', 'acc')} FROM r WHERE gold {{}} 200000 GROUP BY ROLLUP (qtype))"

QUERIES = {
    "metric_recall_mrr_ndcg": (metrics, f"""WITH {BASE}, h AS (SELECT qid, chunk_id AS key, rank FROM rk WHERE rank <= 10), g AS (SELECT qid, chunk_id AS key FROM rken WHERE rank <= 2 UNION SELECT item_id, -1 FROM benchmark), n AS (SELECT qid, count(*) AS n_gold FROM g GROUP BY qid),
 f AS (SELECT qid, key, min(rank) AS rank FROM h JOIN g USING (qid, key) GROUP BY ALL), p AS (SELECT qid, count(*) FILTER (rank <= 1) AS c1, count(*) FILTER (rank <= 5) AS c5, count(*) FILTER (rank <= 10) AS c10, min(rank) AS best FROM f GROUP BY qid), d AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT qid, rank FROM f) GROUP BY qid)
 SELECT qid, n_gold, round(coalesce(c1, 0) / n_gold, 6) AS recall_1, round(coalesce(c5, 0) / n_gold, 6) AS recall_5, round(coalesce(c10, 0) / n_gold, 6) AS recall_10, (coalesce(c1, 0) > 0)::INT AS hit_1, (coalesce(c5, 0) > 0)::INT AS hit_5, (coalesce(c10, 0) > 0)::INT AS hit_10, round(coalesce(1 / best, 0), 6) AS mrr,
 round(coalesce(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_gold, 10) + 1)]), 0), 6) AS ndcg FROM n LEFT JOIN p USING (qid) LEFT JOIN d USING (qid)"""),
    "metric_aggregate_accuracy": (aggregate_accuracy, f"WITH {RESULTS} SELECT qtype, round(avg((NOT refused AND abs(pred - gold) <= greatest(1e-9, 1e-6 * greatest(abs(pred), abs(gold))))::INT), 6) AS accuracy, count(*) AS n FROM r GROUP BY qtype"),
    "metric_refusal_rates": (rates, f"WITH {RESULTS} SELECT qtype, count(*) AS n, {RATES} FROM r GROUP BY ROLLUP (qtype)"),
    "metric_router_confusion": (confusion, f"WITH {RESULTS} SELECT er AS expected_route, count(*) FILTER (route = 'lookup') AS lookup, count(*) FILTER (route = 'aggregate') AS \"aggregate\", count(*) FILTER (route = 'hybrid') AS hybrid FROM r GROUP BY er"),
    "metric_citations": (citations, "WITH c AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS key FROM lineitem WHERE l_linenumber <= 4), g AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS key FROM lineitem WHERE l_linenumber >= 3), nc AS (SELECT qid, count(*) AS nc FROM c GROUP BY qid), ng AS (SELECT qid, count(*) AS ng FROM g GROUP BY qid), b AS (SELECT qid, count(*) AS ok FROM c JOIN g USING (qid, key) GROUP BY qid) SELECT qid, round(coalesce(ok, 0) / nc, 6) AS \"precision\", round(coalesce(ok, 0) / ng, 6) AS recall FROM (SELECT coalesce(nc.qid, ng.qid) AS qid, nc, ng FROM nc FULL JOIN ng ON nc.qid = ng.qid) LEFT JOIN b USING (qid)"),
    "stratified_sample": (stratified, "SELECT chunk_id, lang FROM (SELECT doc_id AS chunk_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 25"),
    "gold_values": (gold_by_type, "SELECT o_orderstatus, count(x) AS n, round(avg(x), 4) AS mean, min(x) AS low, max(x) AS high FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS x FROM orders) GROUP BY o_orderstatus"),
    "compare_runs": (comparison, f"WITH {RESULTS} SELECT coalesce(a.qtype, b.qtype) AS qtype, a.n AS n_a, b.n AS n_b, b.n - a.n AS n_change, round(b.acc - a.acc, 6) AS accuracy_change FROM {HALF.format('<=')} a FULL JOIN {HALF.format('>')} b ON a.qtype IS NOT DISTINCT FROM b.qtype"),
}

"""Retrieval and answer metrics, over all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def covered(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, key, rank): the first rank at which each gold key is seen. hits (qid, key, rank), gold (qid, key)."""
    return hits.join(gold.select("qid", "key").distinct(), ["qid", "key"]).groupBy("qid", "key").agg(F.min("rank").alias("rank"))


def retrieval(hits: DataFrame, gold: DataFrame, at: tuple[int, ...] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """(qid, n_gold, recall_k, hit_k, mrr, ndcg) of each question that has gold keys."""
    n = gold.select("qid", "key").distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    first = covered(hits, gold)
    counts = [F.count_if(F.col("rank") <= k).alias(f"c{k}") for k in at]
    per = first.groupBy("qid").agg(*counts, F.min("rank").alias("best"))
    novel = first.where(F.col("rank") <= depth).select("qid", "rank").distinct().groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = n.join(per, "qid", "left").join(novel, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(depth)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = F.lit(0)
    out = [F.round(F.coalesce(f"c{k}", zero) / F.col("n_gold"), 6).alias(f"recall_{k}") for k in at]
    out += [(F.coalesce(f"c{k}", zero) > 0).cast("int").alias(f"hit_{k}") for k in at]
    return rows.select("qid", "n_gold", *out, F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


def scalar_correct(predicted: Column, gold: Column, kind: Column) -> Column:
    """Whole numbers exactly; fractions to a millionth of their size, or 1e-9. A missing value is wrong unless gold is too."""
    close = F.abs(predicted - gold) <= F.greatest(F.lit(1e-9), F.lit(1e-6) * F.greatest(F.abs(predicted), F.abs(gold)))
    return F.when(gold.isNull() | predicted.isNull(), gold.isNull() & predicted.isNull()).when(kind == "int", predicted == gold).otherwise(close)


def citation_scores(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, precision, recall): null where nothing is cited, or there's no gold. cited (qid, key), gold (qid, key)."""
    c, g = cited.select("qid", "key").distinct(), gold.select("qid", "key").distinct()
    both = c.join(g, ["qid", "key"], "left_semi").groupBy("qid").agg(F.count("*").alias("ok"))
    nc, ng = c.groupBy("qid").agg(F.count("*").alias("nc")), g.groupBy("qid").agg(F.count("*").alias("ng"))
    rows = nc.join(ng, "qid", "full_outer").join(both, "qid", "left")
    ok = F.coalesce("ok", F.lit(0))
    return rows.select("qid", F.round(ok / F.col("nc"), 6).alias("precision"), F.round(ok / F.col("ng"), 6).alias("recall"))


def summary(results: DataFrame, by: str = "qtype") -> DataFrame:
    """Rates by type and, with a null type, over all, in one pass.

    results: qtype, answerable, refused, crashed, route, expected_route, correct, used_sql. A crash isn't a refusal.
    """
    refused = F.col("refused") & ~F.col("crashed")
    answered = ~F.col("refused") & ~F.col("crashed")
    rate = lambda hit, base: F.round(F.count_if(hit & base) / F.nullif(F.count_if(base), F.lit(0)), 6)
    every = F.lit(True)
    return results.rollup(by).agg(
        F.count("*").alias("n"),
        rate(answered, ~F.col("answerable")).alias("false_answer_rate"),
        rate(refused, ~F.col("answerable")).alias("refusal_rate"),
        rate(refused, F.col("answerable")).alias("false_refusal_rate"),
        rate(F.col("route") == F.col("expected_route"), every).alias("router_accuracy"),
        rate(F.col("correct"), F.col("expected_route") != "lookup").alias("aggregate_accuracy"),
        rate(F.col("used_sql"), F.col("expected_route") != "lookup").alias("sql_coverage"),
    )


ROUTES = ("lookup", "aggregate", "hybrid")


def confusion(results: DataFrame) -> DataFrame:
    """Expected route by predicted route, as counts."""
    counts = [F.count_if(F.col("route") == r).alias(r) for r in ROUTES]
    return results.groupBy("expected_route").agg(*counts)


def stratified_sample(df: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """Exactly n rows of each stratum (or all it has), the same ones every time."""
    place = W.partitionBy(stratum).orderBy(F.md5(F.col(order).cast("string").cast("binary")), order)
    return df.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= n).drop("__n")


def grid(base, dense=(True, False), rerank=(False, True), kinds=(("row",), ("schema_card",), None)) -> list:
    """The settings of an ablation grid: three retrievers x rerank x chunk kinds."""
    cells = []
    for d, lexical in ((True, False), (False, True), (True, True)):
        for r in rerank:
            for k in kinds:
                cells.append(base.with_(dense=d, lexical=lexical, rerank=r, kinds=k))
    return cells


def compare(a: DataFrame, b: DataFrame, key: str = "qtype") -> DataFrame:
    """Two summaries side by side: every measure of both and its difference."""
    names = [c for c in a.columns if c != key]
    left, right = a.select(key, *(F.col(c).alias(f"{c}_a") for c in names)), b.select(key, *(F.col(c).alias(f"{c}_b") for c in names))
    joined = left.withColumnRenamed(key, "__k").join(right, F.col("__k").eqNullSafe(F.col(key)), "full_outer")
    return joined.select(F.coalesce("__k", key).alias(key), *(x for c in names for x in (F.col(f"{c}_a"), F.col(f"{c}_b"), (F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_change"))))


def markdown(rows: list[dict]) -> str:
    """A table of result rows."""
    if not rows:
        return ""
    head = list(rows[0])
    show = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(show(r[c]) for c in head) + " |" for r in rows)])

"""Runs question sets against engines, cell by cell of a grid of settings, and says what came out."""

from __future__ import annotations

import json
import platform
import time
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import RetrievalConfig
from lodestone.engine import Engine
from lodestone.evals import questions as Q
from lodestone.operators import evaluate as V
from lodestone.operators.stage import staged


def graded(engine: Engine, asked: list[Q.Question], config: RetrievalConfig) -> tuple[DataFrame, DataFrame]:
    """(results, retrieval metrics): a row for each question, and one for each that should find rows.

    All lookups go through the engine in one batch, and so do the computed answers.
    """
    spark = engine.spark
    answers = engine.ask_many([q.text for q in asked], config)
    cited = [(q.qid, f"{c.get('table')}:{c.get('pk') or ''}") for q, a in zip(asked, answers) for c in a.citations if c.get("kind") != "sql_result"]
    rows = [(q.qid, a.route, a.refused, a.reason.startswith("error"), a.sql is not None, float(a.value) if isinstance(a.value, (int, float)) else None) for q, a in zip(asked, answers)]
    got = spark.createDataFrame(rows, "qid string, route string, refused boolean, crashed boolean, used_sql boolean, predicted double")
    results = Q.frame(spark, asked).join(got, "qid")
    correct = F.coalesce(V.scalar_correct(F.when(~F.col("refused"), F.col("predicted")), F.col("gold"), F.col("kind")), F.lit(False))
    results = staged(results.withColumn("correct", correct & F.col("answerable")))
    gold = Q.gold_rows(spark, asked)
    finding = spark.createDataFrame([(q.qid, q.text) for q in asked if q.rows], "qid string, text string")
    hits = engine.retrieve(finding, config).join(engine.index["chunks"].select("chunk_id", "table", "pk", "kind"), "chunk_id")
    keyed = hits.select("qid", F.concat_ws(":", "table", F.when(F.col("kind") == "schema_card", "").otherwise(F.col("pk"))).alias("key"), "rank")
    scores = V.retrieval(keyed, gold).join(V.citation_scores(spark.createDataFrame(cited, "qid string, key string"), gold), "qid", "left")
    return results, scores


def cell(engine: Engine, asked: list[Q.Question], config: RetrievalConfig) -> dict:
    """One row of a results table."""
    began = time.time()
    results, scores = graded(engine, asked, config)
    found = scores.agg(*(F.round(F.avg(c), 4).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg", "precision", "recall"))).first().asDict()
    rates = V.summary(results).where("qtype is null").drop("qtype").first().asDict()
    return {"cell": config.name, **found, **rates, "seconds": round(time.time() - began, 1)}


def run_grid(engine: Engine, asked: list[Q.Question], base: RetrievalConfig = RetrievalConfig(), timebox_s: float = 5400, done: list[dict] | None = None, keep=None) -> list[dict]:
    """All cells of the grid over one sample of questions.

    Cells already done (by name) aren't run again, and keep(rows) is called after each, so a run can go on where it broke
    off. If the first cell says that the others won't fit the timebox, the questions are cut to an even share of each type
    and the grid starts again with them: all cells see the same questions.
    """
    rows, began = list(done or []), time.time()
    cells = [c for c in V.grid(base) if c.name not in {r["cell"] for r in rows}]
    for n, config in enumerate(cells):
        rows.append(cell(engine, asked, config))
        if n == 0 and not done and (time.time() - began) * len(cells) > timebox_s:
            share = max(1, int(len(asked) * timebox_s / ((time.time() - began) * len(cells)) / len(Q.TYPES)))
            asked, rows = Q.sample(asked, share), []
            rows.append(cell(engine, asked, config))
        if keep:
            keep(rows)
    return rows


def distractors(results: DataFrame) -> DataFrame:
    """(template, n, answered): how often each kind of unanswerable question was answered all the same."""
    kind = F.regexp_extract("qid", r"^\w+-(\w+)-\d+$", 1)
    return results.where(~F.col("answerable")).groupBy(kind.alias("template")).agg(F.count("*").alias("n"), F.count_if(~F.col("refused")).alias("answered"))


def held_out_gap(dev: DataFrame, heldout: DataFrame) -> DataFrame:
    """Rates of both sets side by side, with their differences."""
    return V.compare(V.summary(dev), V.summary(heldout))


def provenance(engine: Engine, shop, asked: list[Q.Question], seed: int) -> dict:
    """What a result was made with."""
    from lodestone.functions.tokenizer import get_tokenizer
    from lodestone.operators import index as I

    t = get_tokenizer()
    return {"seed": seed, "sizes": asdict(shop.sizes), "content_hash": shop.content_hash(), "questions": len(asked), "embedder": engine.embedder, "embedder_fallback": I.FALLBACK_REASON.get(engine.embedder), "tokenizer": t.name, "tokenizer_degraded": t.degraded, "python": platform.python_version(), "spark": engine.spark.version}


def report(rows: list[dict], made_with: dict) -> tuple[str, str]:
    """(JSON, Markdown)"""
    return json.dumps({"provenance": made_with, "cells": rows}, indent=1, default=str), V.markdown(rows) + "\n\n" + "\n".join(f"* {k}: {v}" for k, v in made_with.items())

"""From ranked chunks to a cited answer or a refusal, for many questions at once.

hits: (qid, chunk_id, score, rank, text, ...); questions: (qid, text). What is measured over the hits of a
question is grouped by question; a question has at most as many hits as retrieval was asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.config import GenerationConfig
from lodestone.functions import text as X
from lodestone.operators.stage import staged

SEPARATOR_TOKENS = 2
MAX_BLOCKS, MAX_SEGMENTS, EVIDENCE = 3, 2, 0.6
MAX_SPAN, MAX_SEGMENT, HEADER_ROWS = 240, 400, 3
PREAMBLE = "From the retrieved records:"


def term_weights(hits: DataFrame) -> DataFrame:
    """(qid, term, df, n): in how many of a question's hits a term occurs."""
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    df = hits.select("qid", F.explode(F.array_distinct(X.terms(F.coalesce("text", F.lit(""))))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("df"))
    return df.join(n, "qid")


def weight(n: Column, df: Column) -> Column:
    return F.log(1 + n / (1 + df))


def overlaps(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, chunk_id, overlap, plain): the share of a question's weighted terms, and of its terms, that a hit covers."""
    asked = questions.select("qid", F.explode(X.unique_terms(F.col("text"))).alias("term"))
    df, n = term_weights(hits).drop("n"), hits.groupBy("qid").agg(F.count("*").alias("n"))
    weighed = asked.join(n, "qid").join(df, ["qid", "term"], "left").select("qid", "term", weight(F.col("n"), F.coalesce("df", F.lit(0))).alias("w"))
    total = weighed.groupBy("qid").agg(F.sum("w").alias("total"), F.count("*").alias("terms"))
    present = hits.select("qid", "chunk_id", F.explode(F.array_distinct(X.terms(F.coalesce("text", F.lit(""))))).alias("term"))
    got = present.join(weighed, ["qid", "term"]).groupBy("qid", "chunk_id").agg(F.sum("w").alias("got"), F.count("*").alias("hit"))
    rows = hits.select("qid", "chunk_id").join(total, "qid", "left").join(got, ["qid", "chunk_id"], "left")
    zero = F.lit(0.0)
    return rows.select("qid", "chunk_id", F.round(F.coalesce(F.col("got") / F.col("total"), zero), 6).alias("overlap"), F.round(F.coalesce(F.col("hit") / F.col("terms"), zero), 6).alias("plain"))


def entities(questions: DataFrame, hits: DataFrame, caseless_min: int = 4) -> DataFrame:
    """(qid, n_entities, grounded, coverage): how many value-like terms of a question occur in any of its hits."""
    found = questions.select("qid", F.explode(X.entity_terms(F.col("text"), caseless_min)).alias("term"))
    marked = found.join(term_weights(hits).select("qid", "term", "df"), ["qid", "term"], "left")
    counted = marked.groupBy("qid").agg(F.count("*").alias("n_entities"), F.count("df").alias("grounded"))
    return questions.select("qid").join(counted, "qid", "left").select("qid", F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"), F.coalesce("grounded", F.lit(0)).cast("long").alias("grounded")).withColumn("coverage", F.when(F.col("n_entities") == 0, 1.0).otherwise(F.round(F.col("grounded") / F.greatest("n_entities", F.lit(1)), 6)))


def assess(questions: DataFrame, hits: DataFrame, config: GenerationConfig = GenerationConfig()) -> DataFrame:
    """(qid, code, best_score, supporting, overlap, plain, coverage): four gates in order; `supported` passes all."""
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "rank", "chunk_id")
    scored = hits.join(overlaps(questions, hits), ["qid", "chunk_id"]).withColumn("__n", F.row_number().over(order))
    near = F.col("__n") <= max(1, config.overlap_top_k)
    per = scored.groupBy("qid").agg(
        F.max("score").alias("best_score"),
        F.count_if(F.col("score") >= config.min_support_score).alias("supporting"),
        F.max(F.when(near, F.col("overlap"))).alias("overlap"),
        F.max(F.when(near, F.col("plain"))).alias("plain"),
    )
    asked = questions.select("qid", F.size(X.unique_terms(F.col("text"))).alias("n_terms"))
    out = asked.join(per, "qid", "left").join(entities(questions, hits, config.caseless_min), "qid")
    code = (
        F.when(F.col("best_score").isNull(), "no_hits")
        .when(F.col("best_score") < config.min_support_score, "low_support_score")
        .when(F.col("supporting") < config.min_support_chunks, "insufficient_support_chunks")
        .when((F.col("n_terms") > 0) & (F.col("overlap") < config.min_overlap), "low_lexical_overlap")
        .when((F.col("n_entities") > 0) & (F.col("coverage") < config.min_entity_coverage), "ungrounded_entities")
        .otherwise("supported")
    )
    return out.select("qid", code.alias("code"), "best_score", F.coalesce("supporting", F.lit(0)).cast("long").alias("supporting"), "overlap", "plain", "coverage")


def sanitized(text: Column) -> Column:
    """Brackets in data as parentheses: markers are the only brackets in a prompt."""
    return F.translate(text, "[]", "()")


def block(marker: Column, hit: dict[str, Column]) -> Column:
    rows = F.when(hit["pk"] != "", F.concat(F.lit(" rows="), hit["table"], F.lit(":"), hit["pk"])).otherwise("")
    return F.concat(F.lit("["), marker.cast("string"), F.lit("] source="), hit["source_id"], F.lit(" kind="), hit["kind"], F.lit(" table="), hit["table"], rows, F.lit(" score="), F.format_string("%.3f", hit["score"]), F.lit("\n"), hit["body"])


def pack(hits: DataFrame, config: GenerationConfig = GenerationConfig(), reserved: Column | int = 0) -> DataFrame:
    """hits with marker, body and cost: what fits the budget, the lowest scores left out first, numbered in input order.

    What is kept is the longest prefix by falling score whose running cost fits, which a window finds in one pass.
    """
    mark = X.count_tokens
    body = F.when(mark(F.col("text")) <= config.max_chunk_tokens, F.col("text")).otherwise(F.concat(F.rtrim(X.truncate_tokens(F.col("text"), max(1, config.max_chunk_tokens - 6))), F.lit(" …[truncated]")))
    rows = hits.withColumn("body", sanitized(body))
    n = F.count("*").over(W.partitionBy("qid"))
    widest = F.repeat(F.lit("9"), F.length(n.cast("string")))
    rows = rows.withColumn("cost", mark(block(widest, {c: F.col(c) for c in ("pk", "table", "source_id", "kind", "score", "body")})).cast("long"))
    running = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("rank")).rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(F.col("cost") + SEPARATOR_TOKENS).over(running) - SEPARATOR_TOKENS + reserved
    fits = F.max((used > config.max_prompt_tokens).cast("int")).over(running) == 0
    kept = rows.withColumn("__fits", fits).where("__fits").drop("__fits")
    return kept.withColumn("marker", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).drop("n")


def segments(text: Column) -> Column:
    """Citable units in order: lines, split at field ends."""
    parts = F.split(F.regexp_replace(text, r"; | \| |(?<=\.) ", "\n"), "\n")
    return F.filter(F.transform(parts, lambda p: F.rtrim(F.substring(F.regexp_replace(p, r"^[ \t•-]+|[ \t•-]+$", ""), 1, MAX_SEGMENT))), lambda p: p != "")


def evidence(questions: DataFrame, packed: DataFrame) -> DataFrame:
    """(qid, marker, place, segment): the segments an extractive answer is made of.

    The best block always counts; others need EVIDENCE of the best overlap; MAX_BLOCKS blocks, MAX_SEGMENTS segments each.
    """
    blocks = packed.select("qid", F.col("marker").cast("string").alias("chunk_id"), "marker", "score", F.col("body").alias("text"))
    scored = blocks.join(overlaps(questions, blocks).select("qid", "chunk_id", "overlap"), ["qid", "chunk_id"])
    scored = scored.withColumn("best", F.max("overlap").over(W.partitionBy("qid"))).withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "marker")))
    chosen = scored.where((F.col("n") == 1) | ((F.col("best") > 0) & (F.col("overlap") >= F.round(F.col("best") * EVIDENCE, 6))))
    chosen = chosen.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "marker"))).where(F.col("n") <= MAX_BLOCKS)
    lines = chosen.select("qid", "marker", F.col("n").alias("block_n"), F.posexplode(segments(F.col("text"))).alias("place", "segment"))
    asked = questions.select("qid", X.unique_terms(F.col("text")).alias("q"))
    share = F.size(F.array_intersect("q", X.terms(F.col("segment")))) / F.greatest(F.size("q"), F.lit(1))
    ranked = lines.join(asked, "qid").withColumn("share", F.round(share, 6)).withColumn("n", F.row_number().over(W.partitionBy("qid", "marker").orderBy(F.col("share").desc(), "place")))
    return ranked.where(F.col("n") <= MAX_SEGMENTS).select("qid", "block_n", "marker", "place", "segment")


def compose(questions: DataFrame, packed: DataFrame, config: GenerationConfig = GenerationConfig()) -> DataFrame:
    """(qid, body): the evidence as lines with their markers, as many as fit the answer's budget."""
    lines = evidence(questions, packed).withColumn("line", F.concat(F.lit("- "), F.col("segment"), F.lit(" ["), F.col("marker").cast("string"), F.lit("]")))
    order = W.partitionBy("qid").orderBy("block_n", "place").rowsBetween(W.unboundedPreceding, 0)
    fits = lines.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("block_n", "place"))).withColumn("used", F.sum(X.count_tokens(F.col("line")) + 1).over(order))
    kept = fits.where((F.col("n") == 1) | (F.col("used") + 6 <= config.max_answer_tokens))
    return kept.groupBy("qid").agg(F.array_join(F.concat(F.array(F.lit(PREAMBLE)), F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])), "\n").alias("body"))  # at most MAX_BLOCKS x MAX_SEGMENTS lines


def markers(text: Column) -> Column:
    """The numbers in [n], once each, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,4})\]"), F.lit(1)), lambda m: m.cast("int")))


def resolve(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """(qid, marker, chunk_id, valid) of every marker in (qid, body)."""
    said = answers.select("qid", F.explode(markers(F.col("body"))).alias("marker"))
    return said.join(packed.select("qid", "marker", "chunk_id"), ["qid", "marker"], "left").withColumn("valid", F.col("chunk_id").isNotNull())


def quoted(text: Column, question_terms: Column) -> Column:
    """The line that covers most of the question, at most MAX_SPAN characters, cut at a space."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    scored = F.transform(lines, lambda line, i: F.struct((-F.size(F.array_intersect(question_terms, X.terms(line)))).alias("s"), i.alias("i"), line.alias("line")))
    best = F.element_at(F.array_sort(scored), 1)["line"]
    cut = F.substring(best, 1, MAX_SPAN)
    return F.when(F.length(best) <= MAX_SPAN, best).otherwise(F.concat(F.rtrim(F.regexp_replace(cut, r"\s+\S*$", "")), F.lit("…")))


def finalize(questions: DataFrame, answers: DataFrame, packed: DataFrame) -> DataFrame:
    """(qid, text, refused, reason, citations): invented markers go; without a valid one the answer is a refusal."""
    cited = resolve(answers, packed)
    asked = questions.select("qid", X.unique_terms(F.col("text")).alias("q"))
    rows = cited.join(packed.select("qid", "marker", "source_id", "kind", "table", "pk", "score", "body"), ["qid", "marker"], "left").join(asked, "qid", "left")
    own = F.struct("marker", "chunk_id", "source_id", "kind", "table", "pk", "score", quoted(F.col("body"), F.col("q")).alias("quoted_span"))
    per = rows.groupBy("qid").agg(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("valid"), own)))).alias("citations"), F.collect_list(F.when(~F.col("valid"), F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("]")))).alias("bad"))
    out = answers.join(per, "qid", "left").withColumn("citations", F.coalesce("citations", F.array().cast(per.schema["citations"].dataType)))
    cleaned = F.aggregate(F.coalesce("bad", F.array().cast("array<string>")), F.col("body"), lambda a, b: F.replace(a, b, F.lit("")))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(cleaned, r"[ \t]{2,}", " "), r"[ \t]+([.,;:!?])", "$1"))
    refused = F.size("citations") == 0
    return out.select("qid", F.when(refused, "").otherwise(cleaned).alias("text"), refused.alias("refused"), F.when(refused, "no_valid_citations").otherwise("").alias("reason"), "citations")


def answer(questions: DataFrame, hits: DataFrame, config: GenerationConfig = GenerationConfig()) -> DataFrame:
    """Extractive answers: (qid, text, refused, reason, citations) for every question."""
    hits = staged(hits)  # as many rows for each question as retrieval gave, read several times
    gate = staged(assess(questions, hits, config).select("qid", "code"))
    packed = staged(pack(hits.join(gate.where("code = 'supported'"), "qid", "left_semi"), config))
    done = finalize(questions, staged(compose(questions, packed, config)), packed)
    none = F.array().cast(done.schema["citations"].dataType)
    all_ = gate.join(done, "qid", "left")
    reason = F.when(F.col("code") != "supported", F.col("code")).when(F.col("refused").isNull(), "no_extractable_answer").otherwise(F.col("reason"))
    return all_.select("qid", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("refused", F.lit(True)).alias("refused"), reason.alias("reason"), F.coalesce("citations", none).alias("citations"))

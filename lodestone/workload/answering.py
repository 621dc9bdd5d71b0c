"""Gates, packing, extraction and citations over the ten best documents of each benchmark item."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import GenerationConfig
from lodestone.operators import answer as A
from lodestone.operators.stage import staged, with_rows
from lodestone.workload import retrieval as R
from lodestone.workload.chunking import PIECE
from lodestone.workload.retrieval import BASE, stop_list

BUDGET = GenerationConfig(max_prompt_tokens=2000, max_chunk_tokens=300)


def hits(spark, directory):
    texts = R.documents(spark, directory).select("chunk_id", "text", F.lit("parquet").alias("source_id"), F.lit("row").alias("kind"), F.lit("documents").alias("table"), F.col("chunk_id").cast("string").alias("pk"))
    return staged(with_rows(staged(R.bm25(spark, directory)), texts))  # ten rows for each question, read several times


def overlap_gate(spark, directory):
    return A.overlaps(R.questions(spark, directory), hits(spark, directory))


def entity_gate(spark, directory):
    return A.entities(R.questions(spark, directory), hits(spark, directory))


def refusal_codes(spark, directory):
    """With a floor of 0.6 for overlap, so that both outcomes occur."""
    return A.assess(R.questions(spark, directory), hits(spark, directory), GenerationConfig(min_overlap=0.6)).select("qid", "code", "supporting", "coverage")


def pack_budget(spark, directory):
    return A.pack(hits(spark, directory), BUDGET).select("qid", "chunk_id", "marker", "cost")


def extractive_lines(spark, directory):
    packed = staged(A.pack(hits(spark, directory), BUDGET))
    return A.evidence(R.questions(spark, directory), packed).select("qid", "marker", F.col("place").cast("long").alias("place"), F.sha2("segment", 256).alias("segment_hash"))


def citation_resolve(spark, directory):
    """Markers 1, 2 and one that doesn't exist, in answers made up for every conversation turn."""
    said = spark.read.parquet(f"{directory}/conversations.parquet").select(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.concat(F.translate("text", "[]", ""), F.lit(" [1][2] and ["), ((F.col("turn") % 3) + 2).cast("string"), F.lit("]")).alias("body"))
    known = said.select("qid", F.explode(F.array(F.lit(1), F.lit(2))).alias("marker")).withColumn("chunk_id", F.concat_ws("#", "qid", F.col("marker").cast("string")))
    return A.resolve(said, known).select("qid", "marker", "valid")


def answers(spark, directory):
    """Extractive answers; every one that isn't a refusal has citations."""
    done = A.answer(R.questions(spark, directory), hits(spark, directory))
    return done.select("qid", "refused", "reason", F.size("citations").alias("n_citations"))


FOLD = "CASE WHEN length(lower({0})) > 3 AND ends_with(lower({0}), 's') AND NOT ends_with(lower({0}), 'ss') THEN left(lower({0}), length(lower({0})) - 1) ELSE lower({0}) END"
RAW = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"


def kept(x: str) -> str:
    return rf"{x} NOT IN {stop_list()} AND (length({x}) >= 2 OR regexp_matches({x}, '^\d$'))"


def terms(text: str, raw_filter: str | None = None) -> str:
    raw = RAW.format(text)
    if raw_filter:
        raw = f"list_filter({raw}, lambda r: {raw_filter})"
    return f"list_filter(list_transform({raw}, lambda t: {FOLD.format('t')}), lambda x: {kept('x')})"


HITS = f"{BASE}, hit AS (SELECT qid, chunk_id, score, rank, text FROM rk JOIN documents ON doc_id = chunk_id WHERE rank <= 10)"
OVERLAP = f"""{HITS}, asked AS (SELECT item_id AS qid, unnest(list_distinct({terms('text')})) AS term FROM benchmark), ht AS (SELECT qid, chunk_id, unnest(list_distinct({terms('text')})) AS term FROM hit),
 nn AS (SELECT qid, count(*) AS n FROM hit GROUP BY qid), hd AS (SELECT qid, term, count(*) AS df FROM ht GROUP BY ALL), wt AS (SELECT a.qid, a.term, ln(1 + n / (1 + coalesce(df, 0))) AS w FROM asked a JOIN nn USING (qid) LEFT JOIN hd USING (qid, term)),
 tot AS (SELECT qid, sum(w) AS total, count(*) AS terms FROM wt GROUP BY qid), got AS (SELECT ht.qid, chunk_id, sum(w) AS got, count(*) AS hit FROM ht JOIN wt USING (qid, term) GROUP BY ALL),
 ov AS (SELECT h.qid, h.chunk_id, h.score, h.rank, round(coalesce(got / total, 0), 6) AS overlap, round(coalesce(hit / terms, 0), 6) AS plain FROM hit h LEFT JOIN tot USING (qid) LEFT JOIN got USING (qid, chunk_id))"""
LIKE_VALUE = r"regexp_matches(r, '\d') OR CASE WHEN lower(r) = upper(r) THEN length(r) >= 4 ELSE regexp_matches(r, '^\p{Lu}') END"
ENTITY = f"""{OVERLAP}, en AS (SELECT item_id AS qid, unnest(list_distinct({terms('text', LIKE_VALUE)})) AS term FROM benchmark), ec AS (SELECT qid, count(*) AS n_entities, count(df) AS grounded FROM en LEFT JOIN hd USING (qid, term) GROUP BY qid),
 eg AS (SELECT item_id AS qid, coalesce(n_entities, 0) AS n_entities, coalesce(grounded, 0) AS grounded, CASE WHEN coalesce(n_entities, 0) = 0 THEN 1.0 ELSE round(grounded / n_entities, 6) END AS coverage FROM benchmark LEFT JOIN ec ON qid = item_id)"""
def codes(least: float) -> str:
    return f"""pq AS (SELECT qid, max(score) AS best, count(*) FILTER (score >= 0.02) AS sup, max(overlap) FILTER (n <= 5) AS ov FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS n FROM ov) GROUP BY qid), nt AS (SELECT item_id AS qid, len(list_distinct({terms('text')})) AS k FROM benchmark)
 SELECT nt.qid, CASE WHEN best IS NULL THEN 'no_hits' WHEN best < 0.02 THEN 'low_support_score' WHEN sup < 1 THEN 'insufficient_support_chunks' WHEN k > 0 AND ov < {least} THEN 'low_lexical_overlap' WHEN n_entities > 0 AND coverage < 0.75 THEN 'ungrounded_entities' ELSE 'supported' END AS code, coalesce(sup, 0) AS supporting, coverage FROM nt LEFT JOIN pq USING (qid) JOIN eg USING (qid)"""


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{PIECE}')"


def packed(budget: GenerationConfig) -> str:
    return f"""pc AS (SELECT *, {tokens('text')} AS p FROM hit), bd AS (SELECT qid, chunk_id, score, rank, translate(CASE WHEN len(p) <= {budget.max_chunk_tokens} THEN text ELSE rtrim(array_to_string(p[1:{budget.max_chunk_tokens - 6}], ''), ' ') || ' …[truncated]' END, '[]', '()') AS body FROM pc),
 wd AS (SELECT *, repeat('9', length((count(*) OVER (PARTITION BY qid))::VARCHAR)) AS m FROM bd), co AS (SELECT *, len({tokens("'[' || m || '] source=parquet kind=row table=documents rows=documents:' || chunk_id || ' score=' || printf('%.3f', score) || chr(10) || body")})::BIGINT AS cost FROM wd),
 us AS (SELECT *, sum(cost + 2) OVER (PARTITION BY qid ORDER BY score DESC, rank) - 2 AS used FROM co), ft AS (SELECT *, max((used > {budget.max_prompt_tokens})::INT) OVER (PARTITION BY qid ORDER BY score DESC, rank) AS over_ FROM us),
 packed AS (SELECT qid, chunk_id, score, body, cost, row_number() OVER (PARTITION BY qid ORDER BY rank) AS marker FROM ft WHERE over_ = 0)"""


SEGMENTS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, '; | \\| ', chr(10), 'g'), '\\. ', '.' || chr(10), 'g'), chr(10)), lambda p: rtrim(substr(trim(p, ' ' || chr(9) || '•-'), 1, 400), ' ')), lambda p: p <> '')"
LINES = f"""bt AS (SELECT qid, marker, unnest(list_distinct({terms('body')})) AS term FROM packed), aq AS (SELECT item_id AS qid, unnest(list_distinct({terms('text')})) AS term FROM benchmark), bn AS (SELECT qid, count(*) AS n FROM packed GROUP BY qid),
 bf AS (SELECT qid, term, count(*) AS df FROM bt GROUP BY ALL), bw AS (SELECT a.qid, a.term, ln(1 + n / (1 + coalesce(df, 0))) AS w FROM aq a JOIN bn USING (qid) LEFT JOIN bf USING (qid, term)), bs AS (SELECT qid, sum(w) AS total FROM bw GROUP BY qid), bg AS (SELECT bt.qid, marker, sum(w) AS got FROM bt JOIN bw USING (qid, term) GROUP BY ALL),
 bo AS (SELECT p.qid, p.marker, p.score, p.body, round(coalesce(got / total, 0), 6) AS ov FROM packed p LEFT JOIN bs USING (qid) LEFT JOIN bg USING (qid, marker)), b1 AS (SELECT *, max(ov) OVER (PARTITION BY qid) AS best, row_number() OVER (PARTITION BY qid ORDER BY score DESC, marker) AS n FROM bo),
 b2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, marker) AS k FROM b1 WHERE n = 1 OR best > 0 AND ov >= round(best * {A.EVIDENCE}, 6)), sg AS (SELECT qid, marker, {SEGMENTS} AS l FROM b2 WHERE k <= {A.MAX_BLOCKS}), ln AS (SELECT qid, marker, unnest(range(len(l))) AS place, unnest(l) AS segment FROM sg),
 qt AS (SELECT item_id AS qid, list_distinct({terms('text')}) AS q FROM benchmark), sh AS (SELECT qid, marker, place, segment, round(len(list_intersect(q, {terms('segment')})) / greatest(len(q), 1), 6) AS share FROM ln JOIN qt USING (qid)),
 rk2 AS (SELECT *, row_number() OVER (PARTITION BY qid, marker ORDER BY share DESC, place) AS n FROM sh)"""

DEFAULTS = GenerationConfig()
#: Lines of evidence as long as they fit the answer; what they cite; questions that a gate stops.
WHOLE = f"""{packed(DEFAULTS)}, {LINES}, el AS (SELECT r.*, b2.k, len({tokens("'- ' || segment || ' [' || r.marker || ']'")}) AS t FROM rk2 r JOIN b2 USING (qid, marker) WHERE r.n <= {A.MAX_SEGMENTS}),
 eu AS (SELECT *, sum(t + 1) OVER (PARTITION BY qid ORDER BY k, place) AS used, row_number() OVER (PARTITION BY qid ORDER BY k, place) AS nth FROM el), ec2 AS (SELECT qid, count(DISTINCT marker) AS c FROM eu WHERE nth = 1 OR used + 6 <= {DEFAULTS.max_answer_tokens} GROUP BY qid),
 cd AS (@CODES@) SELECT cd.qid, code <> 'supported' OR c IS NULL AS refused, CASE WHEN code <> 'supported' THEN code WHEN c IS NULL THEN 'no_extractable_answer' ELSE '' END AS reason, (CASE WHEN code = 'supported' THEN coalesce(c, 0) ELSE 0 END)::INT AS n_citations FROM cd LEFT JOIN ec2 USING (qid)"""

QUERIES = {
    "overlap_gate": (overlap_gate, f"WITH {OVERLAP} SELECT qid, chunk_id, overlap, plain FROM ov"),
    "entity_gate": (entity_gate, f"WITH {ENTITY} SELECT * FROM eg"),
    "refusal_codes": (refusal_codes, f"WITH {ENTITY}, {codes(0.6)}"),
    "pack_budget": (pack_budget, f"WITH {HITS}, {packed(BUDGET)} SELECT qid, chunk_id, marker::INT AS marker, cost FROM packed"),
    "extractive_lines": (extractive_lines, f"WITH {HITS}, {packed(BUDGET)}, {LINES} SELECT qid, marker::INT AS marker, place, sha256(segment) AS segment_hash FROM rk2 WHERE n <= {A.MAX_SEGMENTS}"),
    "citation_resolve": (citation_resolve, "WITH s AS (SELECT conv_id::VARCHAR || '|' || turn::VARCHAR AS qid, turn % 3 + 2 AS m FROM conversations) SELECT qid, 1::INT AS marker, true AS valid FROM s UNION ALL SELECT qid, 2, true FROM s UNION ALL SELECT qid, m::INT, false FROM s WHERE m > 2"),
    "extractive_answers": (answers, f"WITH {ENTITY}, {WHOLE.replace('@CODES@', 'WITH ' + codes(DEFAULTS.min_overlap))}"),
}

"""Lexical and dense retrieval over documents and embeddings, fusion, rerank, expansion, index maintenance.

Questions are the benchmark items; a document's text is a chunk.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import index as I
from lodestone.operators import retrieve as R
from lodestone.operators import scan as S
from lodestone.operators.stage import staged
from lodestone.sources.catalog import Catalog

K = 10


def documents(spark, directory):
    return Catalog(spark, directory).load("documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def questions(spark, directory):
    return Catalog(spark, directory).load("benchmark").select(F.col("item_id").alias("qid"), "text")


def _index(spark, directory):
    docs = documents(spark, directory)
    return I.postings(docs), I.doc_stats(docs)


def postings(spark, directory):
    return I.postings(documents(spark, directory)).select("term", F.col("chunk_id").alias("doc_id"), "tf")


def doc_freq(spark, directory):
    return I.doc_freq(I.postings(documents(spark, directory)))


def corpus_stats(spark, directory):
    posted, stats = _index(spark, directory)
    return I.corpus_stats(posted, stats).select("n", F.round("avgdl", 6).alias("avgdl"), "vocab")


def counted(spark, directory):
    """The documents' share of the questions' words, read from the texts once for all lists that are made of it."""
    return S.count_texts(questions(spark, directory), documents(spark, directory), ("lang",))


ENGLISH = "lang = 'en'"


def bm25(spark, directory, where=None, k=K):
    return S.bm25(counted(spark, directory), k, where)


def bm25_topk(spark, directory):
    return bm25(spark, directory)


def bm25_filtered(spark, directory):
    return bm25(spark, directory, ENGLISH)


def vectors(spark, directory):
    return Catalog(spark, directory).load("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def dense_topk(spark, directory):
    v = vectors(spark, directory)
    return I.knn(v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "vector"), v, K)


def dense_filtered(spark, directory):
    v = vectors(spark, directory)
    return I.knn(v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "vector"), v.where("label < 5"), K)


def l2_normalize(spark, directory):
    scaled = vectors(spark, directory).select("chunk_id", F.transform("vector", lambda x: x.cast("double") * (F.col("chunk_id") % 7)).alias("v"))
    unit = I.normalized(F.col("v"))
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x))
    return scaled.select("chunk_id", F.round(norm, 6).alias("norm"), F.round(F.element_at(unit, 1), 6).alias("first"))


def hashed_embedding(spark, directory):
    items = questions(spark, directory).select(F.col("qid").alias("chunk_id"), "text")
    return I.hashed(items).select("chunk_id", "bucket", "weight")


def upsert(spark, directory):
    """Documents, of which every third has a new text and every fifth is written twice; the last version counts."""
    docs = documents(spark, directory)
    stored = docs.where("chunk_id % 2 = 0").select("chunk_id", F.sha2("text", 256).alias("content_hash"))
    fresh = docs.where("chunk_id % 3 = 0").select("chunk_id", F.sha2(F.concat("text", F.lit("!")), 256).alias("content_hash"), F.lit(1).alias("n"))
    again = docs.where("chunk_id % 15 = 0").select("chunk_id", F.sha2(F.concat("text", F.lit("?")), 256).alias("content_hash"), F.lit(2).alias("n"))
    return I.upsert(stored, fresh.unionByName(again), order="n")


def delete_by_source(spark, directory):
    docs = documents(spark, directory).select("chunk_id", F.col("source").alias("source_id"))
    left, gone = I.delete_by_source(docs, "src3")
    return left.groupBy("source_id").agg(F.count("*").alias("n")).withColumn("deleted", F.lit(gone).cast("long"))


def diff(spark, directory):
    docs = documents(spark, directory)
    old = docs.where("chunk_id % 7 <> 0").select("chunk_id", F.sha2("text", 256).alias("content_hash"))
    new = docs.where("chunk_id % 5 <> 0").select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return I.diff(old, new)


def _lists(spark, directory):
    """Two ranked lists for each question: BM25, and BM25 over English documents only, which weighs half."""
    words = counted(spark, directory)
    a = S.bm25(words, 20).select("qid", F.lit("all").alias("label"), F.lit(1.0).alias("weight"), "chunk_id", "score", "rank")
    b = S.bm25(words, 20, ENGLISH).select("qid", F.lit("en").alias("label"), F.lit(0.5).alias("weight"), "chunk_id", "score", "rank")
    return staged(a.unionByName(b))  # at most forty rows for each question, read several times


def rrf(spark, directory):
    return R.rrf(_lists(spark, directory)).select("qid", "chunk_id", "score", "rank")


def minmax(spark, directory):
    return R.minmax(_lists(spark, directory)).select("qid", "chunk_id", "score", "rank")


def min_score(spark, directory):
    return R.floor_scores(R.rrf(_lists(spark, directory)), 0.9).select("qid", "chunk_id", "score")


def rerank(spark, directory):
    return R.rerank_overlap(questions(spark, directory), bm25(spark, directory, k=20), documents(spark, directory), K)


def expand_punctuation(spark, directory):
    return questions(spark, directory).select("qid", R.plain(F.col("text")).alias("variant"))


NUMBERS = [("a", "1,234,567 rows at 12.500 each"), ("b", "3.00 and 0.10"), ("c", "no numbers, 12,34"), ("d", "2,500.750")]


def expand_number(spark, directory):
    return spark.createDataFrame(NUMBERS, "qid string, text string").select("qid", R.plain_numbers(F.col("text")).alias("variant"))


def _documents_index(spark, directory):
    docs = documents(spark, directory).select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", F.lit("row").alias("kind"), F.lit("documents").alias("table"), F.lit("parquet").alias("source_id"))
    return {"chunks": docs, "texts": docs, "vectors": I.embed(docs)}


def retrieve_lexical(spark, directory):
    """The pipeline with BM25 alone: fifty candidates, fused, reranked, ten left."""
    from lodestone.config import RetrievalConfig

    docs = documents(spark, directory)
    index = {"chunks": docs, "texts": docs}
    return R.retrieve(questions(spark, directory), index, RetrievalConfig(dense=False, k=K)).select("qid", "chunk_id", "score", "rank")


def hybrid(spark, directory):
    """The whole pipeline over all documents, with both retrievers; the benchmark items are the questions."""
    from lodestone.config import RetrievalConfig

    return R.retrieve(questions(spark, directory), _documents_index(spark, directory), RetrievalConfig(k=5)).select("qid", "chunk_id", "score", "rank")


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
BASE = rf"""tok AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
 dl AS (SELECT doc_id, len({WORDS.format('text')})::BIGINT AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
 sc AS (SELECT qid, doc_id AS chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc),
 rken AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
 lists AS (SELECT qid, 'all' AS label, 1.0 AS w, chunk_id, score, rank FROM rk WHERE rank <= 20 UNION ALL SELECT qid, 'en', 0.5, chunk_id, score, rank FROM rken WHERE rank <= 20),
 lw AS (SELECT qid, sum(w) AS w FROM (SELECT qid, label, max(w) AS w FROM lists GROUP BY ALL) GROUP BY qid)"""
RRF = BASE + ", fz AS (SELECT l.qid, chunk_id, round(sum(l.w::DOUBLE / (60 + rank)) / (any_value(lw.w)::DOUBLE / 61), 6) AS score FROM lists l JOIN lw USING (qid) GROUP BY l.qid, chunk_id)"
MINMAX = BASE + ", mm AS (SELECT *, min(score) OVER (PARTITION BY qid, label) AS lo, max(score) OVER (PARTITION BY qid, label) AS hi FROM lists), fz AS (SELECT m.qid, chunk_id, round(sum(m.w::DOUBLE * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END) / any_value(lw.w)::DOUBLE, 6) AS score FROM mm m JOIN lw USING (qid) GROUP BY m.qid, chunk_id)"
RANKED = "SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM fz"


def stop_list() -> str:
    from lodestone.functions.text import STOPWORDS

    return "(" + ", ".join("'" + w + "'" for w in STOPWORDS) + ")"


RERANK = rf"""{BASE}, h AS (@HITS@),
 qt AS (SELECT item_id AS qid, list_filter({WORDS.format('text')}, lambda x: x NOT IN {stop_list()}) AS t FROM benchmark), dt AS (SELECT doc_id AS chunk_id, list_filter({WORDS.format('text')}, lambda x: x NOT IN {stop_list()}) AS t FROM documents),
 pr AS (SELECT h.qid, h.chunk_id, h.score, list_distinct(qt.t) AS q, dt.t AS d, list_distinct([qt.t[i] || ' ' || qt.t[i + 1] FOR i IN range(1, len(qt.t))]) AS qb, [dt.t[i] || ' ' || dt.t[i + 1] FOR i IN range(1, len(dt.t))] AS db FROM h JOIN qt USING (qid) JOIN dt USING (chunk_id)),
 cv AS (SELECT qid, chunk_id, score, q, len(q) AS nq, len(qb) AS nb, len(list_intersect(qb, db)) AS hb, list_intersect(q, d) AS c FROM pr),
 n AS (SELECT qid, count(*) AS n, max(score) AS best FROM cv GROUP BY qid), d2 AS (SELECT qid, term, count(*) AS df FROM (SELECT qid, unnest(c) AS term FROM cv) GROUP BY ALL),
 w AS (SELECT a.qid, a.term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM (SELECT DISTINCT qid, unnest(q) AS term FROM cv) a JOIN n USING (qid) LEFT JOIN d2 USING (qid, term)),
 tw AS (SELECT qid, sum(w) AS total FROM w GROUP BY qid), g AS (SELECT x.qid, x.chunk_id, sum(w.w) AS got FROM (SELECT qid, chunk_id, unnest(c) AS term FROM cv) x JOIN w USING (qid, term) GROUP BY ALL),
 ov AS (SELECT cv.*, n.best, CASE WHEN total > 0 THEN coalesce(got, 0) / total ELSE len(c) / greatest(nq, 1) END AS term FROM cv JOIN n USING (qid) LEFT JOIN tw USING (qid) LEFT JOIN g USING (qid, chunk_id)),
 fz AS (SELECT qid, chunk_id, round(0.5 * score / best + 0.5 * CASE WHEN nb > 0 THEN 0.75 * term + 0.25 * hb / nb ELSE term END, 6) AS score FROM ov)
 SELECT * FROM ({RANKED}) WHERE rank <= {K}"""
DENSE = "WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {}), fz AS (SELECT * FROM s) SELECT * FROM (" + RANKED + f") WHERE rank <= {K}"
DOCS = "FROM documents WHERE"

QUERIES = {
    "bm25_postings": (postings, f"WITH {BASE} SELECT * FROM post"),
    "bm25_doc_freq": (doc_freq, f"WITH {BASE} SELECT * FROM df"),
    "bm25_corpus_stats": (corpus_stats, f"WITH {BASE} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS vocab FROM st"),
    "bm25_topk": (bm25_topk, f"WITH {BASE} SELECT qid, chunk_id, score, rank::INT AS rank FROM rk WHERE rank <= {K}"),
    "bm25_topk_filtered": (bm25_filtered, f"WITH {BASE} SELECT qid, chunk_id, score, rank::INT AS rank FROM rken WHERE rank <= {K}"),
    "dense_topk": (dense_topk, DENSE.format("true")),
    "dense_topk_filtered": (dense_filtered, DENSE.format("v.label < 5")),
    "l2_normalize": (l2_normalize, "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END AS norm, round(CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) END, 6) AS first FROM embeddings"),
    "hashing_embedder": (hashed_embedding, rf"""WITH w AS (SELECT item_id, unnest({WORDS.format('text')}) AS w FROM benchmark), e AS (SELECT item_id, '^' || w || '$' AS e, w FROM w),
 g AS (SELECT item_id, 'w:' || w AS g FROM e UNION ALL SELECT item_id, substr(e, i, n) FROM (SELECT item_id, e, n, unnest(range(1, length(e) - n + 2)) AS i FROM e, (VALUES (3), (4), (5)) s(n))), m AS (SELECT item_id, md5(g) AS d FROM g)
 SELECT item_id AS chunk_id, (('0x' || substr(d, 1, 8))::BIGINT % {I.DIM})::INT AS bucket, sum(CASE WHEN substr(d, 9, 1) >= '8' THEN -1 ELSE 1 END)::DOUBLE AS weight FROM m GROUP BY ALL HAVING sum(CASE WHEN substr(d, 9, 1) >= '8' THEN -1 ELSE 1 END) <> 0"""),
    "index_upsert": (upsert, f"SELECT doc_id AS chunk_id, sha256(text) AS content_hash {DOCS} doc_id % 2 = 0 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, sha256(text || '!') {DOCS} doc_id % 3 = 0 AND doc_id % 15 <> 0 UNION ALL SELECT doc_id, sha256(text || '?') {DOCS} doc_id % 15 = 0"),
    "index_delete_by_source": (delete_by_source, "SELECT source AS source_id, count(*) AS n, (SELECT count(*) FROM documents WHERE source = 'src3') AS deleted FROM documents WHERE source <> 'src3' GROUP BY source"),
    "index_diff": (diff, f"SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'delete' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'skip' END AS action {DOCS} doc_id % 7 <> 0 OR doc_id % 5 <> 0"),
    "hybrid_rrf": (rrf, f"WITH {RRF} {RANKED}"),
    "hybrid_minmax": (minmax, f"WITH {MINMAX} {RANKED}"),
    "min_score_floor": (min_score, f"WITH {RRF} SELECT qid, chunk_id, score FROM fz WHERE score >= 0.9"),
    "rerank_overlap": (rerank, "WITH " + RERANK.replace("@HITS@", "SELECT qid, chunk_id, score FROM rk WHERE rank <= 20")),
    "retrieve_lexical": (retrieve_lexical, "WITH " + RERANK.replace("@HITS@", "SELECT qid, chunk_id, round((1.0::DOUBLE / (60 + rank)) / (1.0::DOUBLE / 61), 6) AS score FROM rk WHERE rank <= 50")),
    "expand_punctuation": (expand_punctuation, r"SELECT item_id AS qid, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS variant FROM benchmark"),
    "expand_number": (expand_number, "SELECT * FROM (VALUES ('a', '1234567 rows at 12.5 each'), ('b', '3 and 0.1'), ('c', 'no numbers, 12,34'), ('d', '2500.75')) t(qid, variant)"),
    "retrieve_pipeline": (hybrid, None),
}

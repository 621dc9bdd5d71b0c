"""Scores in narrow passes: the same as by brute force, with nothing moved or held that grows with the number of words."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import index as I
from lodestone.operators import retrieve as R
from lodestone.operators import scan as S
from lodestone.workload import answering, retrieval


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def by_hand(questions, docs, k, keep=lambda r: True):
    counts = {r["chunk_id"]: Counter(words(r["text"])) for r in docs}
    df = Counter(t for c in counts.values() for t in c)
    n, avgdl = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs)
    out = {}
    for q in questions:
        asked, found = Counter(words(q["text"])), []
        for r in docs:
            c = counts[r["chunk_id"]]
            if keep(r) and asked.keys() & c.keys():
                s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for t, m in asked.items() if t in c)
                found.append((-round(s, 6), r["chunk_id"]))
        out |= {(q["qid"], n + 1): (i, -s) for n, (s, i) in enumerate(sorted(found)[:k])}
    return out


def same(got, want):
    got = {(r["qid"], r["rank"]): (r["chunk_id"], r["score"]) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_bm25_from_texts_moves_no_postings(spark, data, monkeypatch):
    """From texts and from stored postings, in several passes, products and blocks; what is shuffled are running bests alone."""
    docs, asked = retrieval.documents(spark, data).collect(), retrieval.questions(spark, data).collect()
    assert "Generate" not in plan(retrieval.bm25_topk(spark, data)) and "MapInArrow" in plan(retrieval.bm25_topk(spark, data))
    same(retrieval.bm25_topk(spark, data), by_hand(asked, docs, 10))
    monkeypatch.setattr(S, "PASS", 16)
    monkeypatch.setattr(S, "PRODUCT", 5)
    monkeypatch.setattr(S, "CELLS", 1)
    same(retrieval.bm25_filtered(spark, data), by_hand(asked, docs, 10, lambda r: r["lang"] == "en"))
    d = retrieval.documents(spark, data)
    same(I.bm25(retrieval.questions(spark, data), I.postings(d), I.doc_stats(d), 3, d.where("lang = 'en'")), by_hand(asked, docs, 3, lambda r: r["lang"] == "en"))


def test_bm25_odd_tables(spark):
    docs = spark.createDataFrame([("b", "Red red"), ("a", "red RED"), ("c", None), ("d", ""), ("e", "?!")], "chunk_id string, text string")
    asked = spark.createDataFrame([("x", "red"), ("y", None), ("z", "nothing here")], "qid string, text string")
    got = S.bm25(S.count_texts(asked, docs), 5).orderBy("rank").collect()
    assert [(r["qid"], r["chunk_id"], r["rank"]) for r in got] == [("x", "a", 1), ("x", "b", 2)] and got[0]["score"] == got[1]["score"]
    assert S.bm25(S.count_texts(asked.where("false"), docs), 5).count() == 0
    assert S.bm25(S.count_texts(asked, docs.where("false")), 5).count() == 0
    assert S.bm25(S.count_texts(asked, docs.where("text is null")), 5).count() == 0


def test_running_best_is_exact_and_bounded():
    rng, k, n = np.random.default_rng(7), 3, 40
    best, blocks = S.Best(n, k), []
    for b in range(300):
        ids = rng.permutation(1000) + 1000 * b
        scores = np.round(rng.random((n, 1000)), 2) + b  # every block beats the ones before, with many ties
        scores[:, :500] = -np.inf
        blocks.append((ids, scores))
        best.add(0, scores, ids)
        assert best.held <= 2 * n * k + (1 << 16) + n * 1000
    best._prune()
    ids, scores = np.concatenate([i for i, _ in blocks]), np.concatenate([s for _, s in blocks], axis=1)
    q, got, _ = best.parts[0]
    for j in range(n):
        assert got[q == j].tolist() == ids[np.lexsort((ids, -scores[j]))[:k]].tolist()


def test_knn_products_are_of_bounded_size(spark, data, monkeypatch):
    """However many rows a batch has, a product is of VECTOR_BLOCK vectors with QUERY_BLOCK questions at most."""
    want = {tuple(r) for r in retrieval.dense_filtered(spark, data).collect()}
    monkeypatch.setattr(I, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(I, "QUERY_BLOCK", 3)
    monkeypatch.setattr(I, "BROADCAST_QUESTIONS", 10)

    class Watched(S.Best):
        def add(self, first, scores, ids):
            assert scores.shape[0] <= 3 and scores.shape[1] <= 7
            super().add(first, scores, ids)

    monkeypatch.setattr(I, "Best", Watched)
    assert {tuple(r) for r in retrieval.dense_filtered(spark, data).collect()} == want


def test_embedding_is_the_hashed_cells_in_one_pass(spark, data):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é日本 ßx 𝒳y a"), (-4, "ab " * 500)], "chunk_id long, text string")
    docs = retrieval.documents(spark, data).select("chunk_id", "text").limit(60).unionByName(odd)
    got = I.embed(docs)
    assert "Aggregate" not in plan(got) and "Generate" not in plan(got)
    cells = {}
    for r in I.hashed(docs).collect():
        cells.setdefault(r["chunk_id"], {})[r["bucket"]] = r["weight"]
    rows = got.collect()
    assert len(rows) == 64
    for r in rows:
        own = cells.get(r["chunk_id"], {})
        norm = math.sqrt(sum(w * w for w in own.values()))
        assert r["vector"] == [own.get(b, 0.0) / norm if norm else 0.0 for b in range(I.DIM)]


def test_texts_of_hits_are_taken_in_place(spark, data):
    """Few hits go to the texts; no text is moved for them."""
    asked, docs = retrieval.questions(spark, data), retrieval.documents(spark, data)
    hits = retrieval.bm25(spark, data)
    joined = answering.with_rows(hits, docs)
    assert "rightHint=(strategy=broadcast)" in plan(joined) or "leftHint=(strategy=broadcast)" in plan(joined)
    again = R.rerank_overlap(asked, hits, docs.unionByName(docs.select((F.col("chunk_id") + 10**9).alias("chunk_id"), "text", "lang", "source")), 4)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in R.rerank_overlap(asked, hits, docs, 4).collect()}


def test_embedding_forgets_words_and_sums_in_pieces(monkeypatch):
    texts = [words("ab abc abcd é " * 9), [], words(" ".join(f"w{i} x{i % 7}" for i in range(40)))]
    distinct = sorted({w for t in texts for w in t})
    row = np.repeat(np.arange(3), [len(t) for t in texts])
    code = np.array([distinct.index(w) for t in texts for w in t])
    want = I._Cells(16).sums(distinct, row, code, 3)
    monkeypatch.setattr(I._Cells, "MOST", 5)
    monkeypatch.setattr(I._Cells, "PAIRS", 4)
    monkeypatch.setattr(I._Cells, "WORDS", 3)
    cells = I._Cells(16)
    assert all((cells.sums(distinct, row, code, 3) == want).all() for _ in range(3)) and not want[1].any() and want[0].any()
    for bits in (4, 3):  # more letters than numbers: forgotten, or a word's grams one by one
        monkeypatch.setattr(I._Cells, "BITS", bits)
        assert (I._Cells(16).sums(distinct, row, code, 3) == want).all()


def test_vocabularies_move_only_columns_of_few_values(spark, data, monkeypatch):
    from lodestone.operators import profile as P
    from lodestone.workload import profiling

    asked, whole = set(), P.long_form

    def watched(df, names=None):
        asked.update(names if names is not None else df.columns)
        return whole(df, names)

    monkeypatch.setattr(P, "long_form", watched)
    got = {(r["table"], r["column"]): r["categories"].split("|") for r in profiling.vocabularies(spark, data).collect()}
    assert not asked & {"text", "c_name", "p_name", "l_orderkey", "l_extendedprice", "o_totalprice", "props", "n_chars"}
    assert got["orders", "o_orderstatus"] == sorted(got["orders", "o_orderstatus"]) and {c for _, c in got} <= asked and got["labels", "toxic"] == ["0", "1"]


def test_distinct_long_values_are_counted_by_digest(spark):
    from lodestone.operators import profile as P

    rows = spark.createDataFrame([("x" * 500 + str(i % 7),) for i in range(50)] + [("x" * 64,), ("x" * 65,), (None,)], "t string")
    assert P.profile(rows, "t").first()["distinct"] == 9

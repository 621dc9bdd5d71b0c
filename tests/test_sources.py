"""Sources of other kinds behind the same engine, profiles by survey, the persistent index, rerankers by pairs."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import ConfigError, PlanError, SourceError
from lodestone.operators import chunks as C
from lodestone.operators import profile as P
from lodestone.operators import retrieve as R
from lodestone.operators.persistent import PersistentIndex
from lodestone.plans import planner
from lodestone.sources.catalog import Catalog
from lodestone.sources.files import JdbcSource, open_source


@pytest.fixture(scope="module")
def shop_db(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "shop.db")
    with sqlite3.connect(path) as db:
        db.executescript("""create table customers(customer_id integer primary key, full_name text not null, segment text, active boolean, joined date);
            create table orders(order_id integer, line integer, customer_id integer references customers, status text, amount real, placed date, primary key(order_id, line)) without rowid;
            create table notes(x text); create table "odd name"(a int);""")
        db.executemany("insert into customers values(?,?,?,?,?)", [(i, f"Name {i}", ["gold", "silver"][i % 2], i % 3 == 0, f"2024-01-{i % 28 + 1:02}") for i in range(1, 61)])
        db.executemany("insert into orders values(?,?,?,?,?,?)", [(i, i % 3, i % 60 + 1, ["open", "closed", "lost"][i % 3], i * 1.5, f"2024-02-{i % 28 + 1:02}") for i in range(300)])
        db.executemany("insert into notes values(?)", [(c,) for c in "abc"])
    return path


def test_sqlite(spark, shop_db):
    s = open_source(spark, f"sqlite:{shop_db}")
    assert s.tables() == ["customers", "notes", "odd name", "orders"] and s.table("orders").key == ("order_id", "line") and s.references() == [("orders", "customer_id", "customers", "customer_id")]
    assert [(c["name"], c["nullable"]) for c in s.schema("customers")][:2] == [("customer_id", False), ("full_name", True)]
    assert s.load("orders").count() == 300 and s.load("odd name").count() == 0 and [r["_row_ordinal"] for r in s.rows("notes").orderBy("x").collect()] == [0, 1, 2]
    assert s.load("customers").where("customer_id = 3").first()["active"] is True
    with pytest.raises(SourceError):
        s.load("nope")
    with pytest.raises(SourceError):
        open_source(spark, "sqlite:/nowhere.db")
    e = Engine(s)
    values = [a.value for a in e.ask_many(["How many orders have the status 'lost'?", "How many orders were placed by customers in the gold segment?", "What is the total amount of orders per status?", "How many orders have the status 'none'?"])]
    assert values == [100, 150, [("lost", 22575.0), ("closed", 22425.0), ("open", 22275.0)], None]


def test_csv_directory_answers(spark, tmp_path):
    (tmp_path / "people.csv").write_text("id,name,city,joined\n" + "".join(f"{i},N{i},{['Rome', 'Oslo'][i % 2]},2024-03-{i % 28 + 1:02}\n" for i in range(100)))
    e = Engine(open_source(spark, f"files:{tmp_path}"))
    assert e.ask("How many people live in city Oslo?").value == 50
    (tmp_path / "people.csv").write_text("id,name,city,joined\n1,A,Oslo,2024-01-01\n2,B,Bern,2024-01-02\n")
    assert e.ask("How many people live in city Bern?").refused is False  # the words are read again when files change


class Stub(JdbcSource):
    """Answers of an information schema, without a database."""

    def _query(self, sql):
        if "FROM information_schema.tables" in sql:
            return [("orders",), ("customers",)]
        if "key_column_usage" in sql:
            return [("customers", "id", 1, "PRIMARY KEY", "c_pk"), ("orders", "line", 2, "PRIMARY KEY", "o_pk"), ("orders", "id", 1, "PRIMARY KEY", "o_pk"), ("orders", "customer", 1, "FOREIGN KEY", "o_fk")]
        return [("o_fk", "c_pk")]


def test_jdbc_introspection(spark):
    s = Stub(spark, "jdbc:postgresql://secret")
    assert s.tables() == ["customers", "orders"] and s.table("orders").key == ("id", "line") and s.table("orders").refs == {"customer": "customers.id"}
    assert "secret" not in repr(s)
    with pytest.raises(SourceError):
        s.table("nope")


def test_names(spark, shop_db):
    s = open_source(spark, f"sqlite:{shop_db}")
    assert planner.qualified("a`b", "", "c") == "`a``b`.`c`" and planner.table_named(s, "main.Orders") == "orders"
    for bad in ("x\x00y", ""):
        with pytest.raises(PlanError):
            planner.quoted(bad)
    with pytest.raises(PlanError):
        planner.table_named(s, "nope")


def test_survey_agrees_with_profiles(spark, data):
    c = Catalog(spark, data)
    names = ["customer", "part", "orders", "labels", "conversations"]
    rows, values = P.survey({t: c.data(t) for t in names}, {t: (c.table(t).key, c.table(t).refs) for t in names})
    exact = {(r["table"], r["column"]): r for t in names for r in P.profile(c.data(t), t, c.table(t).key, c.table(t).refs).collect()}
    assert {(r["table"], r["column"]): (r["role"], r["lo"], r["hi"], r["nulls"]) for r in rows} == {k: (r["role"], r["lo"], r["hi"], r["nulls"]) for k, r in exact.items()}
    assert {r["value"] for r in values if r["column"] == "o_orderstatus"} == {"F", "O", "P"}


def test_samples_and_families(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "x"), ("2.5", "2024-01-02T10:00:00", "1"), ("1", None, "2024-01-01")], "n string, d string, m string").coalesce(1)
    assert {r["column"]: r["samples"] for r in P.samples(df).collect()} == {"n": ["1", "2.5"], "d": ["2024-01-01", "2024-01-02T10:00:00"], "m": ["x", "1", "2024-01-01"]}
    assert tuple(df.agg(*(P.family_from_values(F.col(c)) for c in "ndm")).first()) == ("FLOAT", "TIMESTAMP", "UNKNOWN")


def test_persistent_index(spark, data, tmp_path):
    path = str(tmp_path / "index")
    c = Catalog(spark, data)
    rows = C.row_chunks(C.row_text(c.load("nation"), "nation", ("n_nationkey",), {}, {}), "nation", "parquet")
    one = PersistentIndex(spark, path)
    assert one.count() == 0 and one.get("x") is None and one.upsert(rows) == 25 and one.upsert(rows) == 0
    two = PersistentIndex(spark, path)  # opened from what is there
    first = next(two.iter_chunks())
    assert two.count() == 25 and two.get(first["chunk_id"]) == first and len(two.vector_of(first["chunk_id"])) == 384
    asked = spark.createDataFrame([(0, "NATION_7")], "qid int, text string")
    for lexical in (True, False):
        hit = two.search(asked, 1, lexical=lexical).first()
        assert "NATION_7" in two.get(hit["chunk_id"])["text"]
    assert two.delete(spark.createDataFrame([(first["chunk_id"],), ("none",)], "chunk_id string")) == 1
    one.refresh()
    assert one.count() == 24 and one.delete_by_source("parquet") == 24 and one.count() == 0


def test_pair_reranker(spark):
    asked = spark.createDataFrame([(0, "q")], "qid int, text string")
    hits = spark.createDataFrame([(0, f"c{i:03}", float(200 - i)) for i in range(120)], "qid int, chunk_id string, score double")
    chunks = spark.createDataFrame([(f"c{i:03}", f"{i}") for i in range(120)], "chunk_id string, text string")
    seen = R.get_reranker("cross-encoder", lambda q, t: [float(x) / 50 for x in t])(asked, hits, chunks, 0).orderBy("rank").collect()
    assert [r["chunk_id"] for r in seen[:2]] == ["c099", "c098"] and [r["chunk_id"] for r in seen[100:102]] == ["c100", "c101"] and seen[100]["score"] == 0
    assert R.get_reranker("cross-encoder") is R.rerank_overlap and "cross-encoder" in R.FALLBACK_REASON
    with pytest.raises(ConfigError):
        R.get_reranker("nope")

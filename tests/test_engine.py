"""Questions end to end over the star schema, and sources."""

import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import ConfigError, IndexError_, SourceError
from lodestone.operators import store
from lodestone.plans import planner
from lodestone.sources.catalog import Catalog
from lodestone.sources.files import FilesSource, open_source

TABLES = ["region", "nation", "customer", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def engine(spark, data):
    e = Engine(Catalog(spark, data))
    e.lexicon(TABLES)
    return e


def test_flagship(spark, data):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert row["route"] == "aggregate" and not row["refused"] and row["citation_chunk_id"].startswith("sql:")


@pytest.mark.parametrize("question,sql", [
    ("How many orders have the status 'F'?", "SELECT COUNT(*) AS value FROM `orders` WHERE `orders`.`o_orderstatus` = 'F'"),
    ("How many orders were placed by customers in the BUILDING segment?", "SELECT COUNT(*) AS value FROM `orders` JOIN `customer` ON `orders`.`o_custkey` = `customer`.`c_custkey` WHERE `customer`.`c_mktsegment` = 'BUILDING'"),
    ("How many orders were placed in May 1996?", "SELECT COUNT(*) AS value FROM `orders` WHERE `orders`.`o_orderdate` >= DATE '1996-05-01' AND `orders`.`o_orderdate` < DATE '1996-06-01'"),
])
def test_plans(engine, question, sql):
    assert planner.to_sql(planner.plan(question, engine.lexicon())) == sql


@pytest.mark.parametrize("question", ["How many orders have the status 'X1'?", "What is the phone number of customer 7?", "How many suppliers2 deliver to Rome?", "How many orders were placed between 2030-01-01 and 2030-12-31?", "How many orders were placed in the first half of 1996?"])
def test_refuses(engine, question):
    assert engine.ask(question).refused


def test_asks(engine):
    a = engine.ask("How many orders have the status 'F'?")
    assert not a.refused and a.value == engine.catalog.load("orders").where("o_orderstatus = 'F'").count() and a.citations[0]["kind"] == "sql_result"
    zero = engine.ask("How many orders were placed by customers in the BUILDING segment before 1995-01-01?")
    assert not zero.refused and zero.value == 0  # none is an answer


def test_router(engine):
    lex = engine.lexicon()
    assert planner.classify("What columns does the orders table have?", lex).schema_question
    assert planner.classify("", lex).name == "lookup" and planner.classify("How many orders are there?", lex).name == "aggregate"
    assert planner.classify("How many orders were placed by customers in the BUILDING segment?", lex).name == "hybrid"


def test_catalog(spark, data):
    c = Catalog(spark, data)
    assert c.path("orders", "customer") == ("o_custkey", "c_custkey") and c.path("customer", "orders") == ("c_custkey", "o_custkey")
    assert [h[1] for h in c.route("lineitem", "customer")] == ["orders", "customer"]
    with pytest.raises(SourceError):
        c.load("nope")
    with pytest.raises(ValueError):
        next(c.iter_rows("region", 0))
    assert [len(b) for b in c.iter_rows("region", 2)] == [2, 2, 1]


def test_files(spark, tmp_path):
    (tmp_path / "people.csv").write_text("id,name,name\n1,Ann,x\n2,,y\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "notes.txt").write_text("no table")
    s = open_source(spark, f"files:{tmp_path}")
    assert isinstance(s, FilesSource) and s.tables() == ["people"] and any("bad.csv" in p for p in s.load_errors)
    df = s.load("people")
    assert df.columns == ["id", "name", "name_2", "_row_ordinal"] and [r["_row_ordinal"] for r in df.orderBy("id").collect()] == [0, 1]
    assert s.null_counts("people")["name"] == 1
    with pytest.raises(ConfigError):
        open_source(spark, "nope:x")


def test_ingest_is_incremental(spark, data):
    e = Engine(Catalog(spark, data))
    first = e.ingest(["region"])
    assert first["insert"] == 6 and e.ingest(["region"]) == {"insert": 0, "update": 0, "skip": 6, "delete": 0}
    assert e.ingest(["nation"])["delete"] == 0 and e.index["chunks"].count() == 6 + 26  # another table stays


def test_ingest_into_a_path(spark, data, tmp_path):
    """Engines add to what is there; versions are never written over."""
    path = str(tmp_path / "index")
    assert Engine(Catalog(spark, data)).ingest(["region"], path=path)["insert"] == 6
    second = Engine(Catalog(spark, data))
    assert second.ingest(["nation"], path=path) == {"insert": 26, "update": 0, "skip": 0, "delete": 0}
    third = Engine(Catalog(spark, data))
    assert third.ingest(["region", "nation"], path=path) == {"insert": 0, "update": 0, "skip": 32, "delete": 0}
    version, tables = store.load(spark, path)
    assert version == 2 and {n: t.select("chunk_id").distinct().count() for n, t in tables.items()} == {"chunks": 32, "postings": 32, "stats": 32, "vectors": 32}
    some = tables["chunks"].where("`table` = 'region' and kind = 'row'")
    changed = some.withColumn("text", F.lit("changed"))
    for _ in range(store.MOST_PARTS + 2):  # beyond this many parts they're merged
        store.commit(spark, path, {"chunks": changed}, changed.select("chunk_id"))
    version, tables = store.load(spark, path)
    assert version == store.MOST_PARTS + 4 and tables["chunks"].count() == 32 and tables["chunks"].where("text = 'changed'").count() == 5
    shutil.rmtree(next((tmp_path / "index").glob(f"v{version}/chunks")))
    with pytest.raises(IndexError_):
        store.load(spark, path)


def test_stream(spark, data, tmp_path):
    """A stream into an index that is there already: all tables follow, nothing is dropped, a second run changes nothing."""
    from lodestone.streaming.ingest import event_counts, ingest_stream, stream_rows

    path = str(tmp_path / "index")
    Engine(Catalog(spark, data)).ingest(["region"], path=path)
    Engine(Catalog(spark, data)).ingest(["customer"], path=path)
    for _ in range(2):
        ingest_stream(stream_rows(spark, data, "nation"), "nation", ("n_nationkey",), path, str(tmp_path / "ckpt")).awaitTermination(90)
    version, tables = store.load(spark, path)
    assert version == 3 and tables["chunks"].where("source_id = 'stream'").count() == 25
    assert {t.select("chunk_id").distinct().count() for t in tables.values()} == {6 + 151 + 25}
    e = Engine(Catalog(spark, data))
    e.open(path)
    asked = spark.createDataFrame([(0, "NATION_7")], "qid int, text string")
    assert "NATION_7" in e.retrieve(asked).join(e.index["chunks"], "chunk_id").orderBy("rank").first()["text"]
    assert event_counts(spark.read.parquet(f"{data}/events.parquet")).agg({"n": "sum"}).first()[0] == 1000

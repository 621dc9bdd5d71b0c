"""The shop, its questions, and the runner, at a small size; prompts and tokenizers."""

import pytest
from pyspark.sql import functions as F

from lodestone.config import GenerationConfig, RetrievalConfig
from lodestone.engine import Engine
from lodestone.evals import questions as Q
from lodestone.evals import run as R
from lodestone.evals.shop import Shop, Sizes
from lodestone.functions.tokenizer import get_tokenizer
from lodestone.operators import prompt as P

SMALL = Sizes(60, 40, 150, 3)


@pytest.fixture(scope="module")
def shop():
    return Shop(7, SMALL)


@pytest.fixture(scope="module")
def engine(spark, shop, tmp_path_factory):
    e = Engine(shop.write(spark, str(tmp_path_factory.mktemp("shop"))))
    e.ingest(list(shop.rows))
    return e


def test_shop_is_seeded(shop):
    assert shop.content_hash() == Shop(7, SMALL).content_hash() != Shop(8, SMALL).content_hash()
    ids = {r["customer_id"] for r in shop.dicts("customers")}
    assert all(r["customer_id"] in ids for r in shop.dicts("orders")) and any(r["email"] is None for r in shop.dicts("customers"))


def test_questions(shop):
    dev, held = Q.build(shop), Q.build(shop, ("heldout",))
    assert {q.template for q in dev}.isdisjoint(q.template for q in held) and len({q.text for q in dev}) == len(dev)
    assert {q.qtype for q in dev + held} == set(Q.TYPES) and Q.build(shop) == dev
    assert [q.qid for q in Q.sample(dev, 2)] == [q.qid for q in Q.sample(dev[::-1], 2)] and len(Q.sample(dev, 2)) <= 16


def test_grid(engine, shop):
    """Computed answers are right, distractors are refused, lookups are found; a run goes on where it stopped."""
    asked = Q.sample(Q.build(shop), 4)
    results, scores = R.graded(engine, asked, RetrievalConfig())
    rows = {r["qid"]: r for r in results.collect()}
    wrong = [q.text for q in asked if q.answerable and q.route != "lookup" and not rows[q.qid]["correct"]]
    assert not wrong
    assert all(rows[q.qid]["refused"] for q in asked if not q.answerable)
    assert scores.agg(F.avg("recall_10")).first()[0] >= 0.8
    assert R.distractors(results).agg(F.sum("answered")).first()[0] == 0
    kept = []
    names = [c.name for c in R.V.grid(RetrievalConfig())]
    done = [{"cell": n} for n in names[1:]]
    out = R.run_grid(engine, asked[:3], done=done, keep=kept.append)
    assert {r["cell"] for r in out} == set(names) and len(kept) == 1
    text, table = R.report(out[-1:], R.provenance(engine, shop, asked, 7))
    assert shop.content_hash() in text and names[0] in table


def test_prompts_fit(spark):
    hits = spark.createDataFrame([("a", f"c{i}", 1.0 - i / 100, i + 1, "s", "row", "t", str(i), "word " * 60) for i in range(8)], "qid string, chunk_id string, score double, rank int, source_id string, kind string, `table` string, pk string, text string")
    asked = spark.createDataFrame([("a", "what is it?"), ("b", "nothing was found")], "qid string, text string")
    for budget in (10_000, 500, 220):
        packed, made = P.fitted(asked, hits, GenerationConfig(max_prompt_tokens=budget))
        rows = {r["qid"]: r for r in made.withColumn("n", P.X.count_tokens(F.col("prompt"))).collect()}
        assert rows["a"]["n"] <= budget or not rows["a"]["markers"]
        assert rows["a"]["markers"] == {r["marker"]: r["chunk_id"] for r in packed.collect()} and not rows["b"]["markers"]
        assert all(f"[{m}] source=s" in rows["a"]["prompt"] for m in rows["a"]["markers"])
    assert spark.range(1).select(P.refused(F.lit(" INSUFFICIENT_CONTEXT\n"))).first()[0]


def test_tokenizer_choice(spark):
    assert get_tokenizer().degraded and get_tokenizer("/nowhere.json").detail.startswith("/nowhere.json")
    public = pytest.importorskip("public_tokenizers")
    t = get_tokenizer(str(public.path("byte_bpe_50k.json")))
    row = spark.createDataFrame([("hello world again",)], "text string").select(t.count(F.col("text")), t.truncate(F.col("text"), 2)).first()
    assert not t.degraded and row[0] == 3 and row[1] == "hello world"

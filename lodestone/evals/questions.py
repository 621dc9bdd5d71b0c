"""Questions about the shop, made from templates, with what a right answer is.

A template is a line of text with the values it takes and the rows or the number that answer it. Each has a seed of its
own, so that adding one changes no other's questions. The dev set and the held-out set share no template.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.evals.shop import CATEGORIES, CHANNELS, SEGMENTS, STATUSES, Shop

TYPES = ("entity", "filter", "count", "numeric", "date", "join", "schema", "distractor")


@dataclass(frozen=True)
class Question:
    qid: str
    text: str
    qtype: str
    template: str
    template_set: str
    route: str
    answerable: bool
    rows: tuple[str, ...] = ()  # table:key of the rows a lookup should find
    scalar: float | None = None
    kind: str = "int"


@dataclass(frozen=True)
class Template:
    key: str
    qtype: str
    set: str
    n: int
    make: Callable[[Shop, random.Random], dict]


TEMPLATES: list[Template] = []


def template(key: str, qtype: str, which: str, n: int = 12):
    """Registers a function that makes one question: text, and rows, scalar or answerable."""

    def keep(make):
        TEMPLATES.append(Template(key, qtype, which, n, make))
        return make

    return keep


def _pick(shop: Shop, rng: random.Random, table: str, *needed: str) -> dict:
    return rng.choice([r for r in shop.dicts(table) if all(r[c] is not None for c in needed)])


def _entity(key: str, which: str, text: str, table: str, id_: str, name: str, column: str) -> None:
    @template(key, "entity", which)
    def make(shop, rng):
        r = _pick(shop, rng, table, column)
        return {"text": text.format(r[name]), "rows": [f"{table}:{r[id_]}"]}


for key, which, text, *of in (
    ("email", "dev", "{}: email on file", "customers", "customer_id", "full_name", "email"),
    ("price", "dev", "unit price of the {}", "products", "product_id", "name", "unit_price"),
    ("tier", "heldout", "loyalty tier for {}", "customers", "customer_id", "full_name", "loyalty_tier"),
    ("described", "heldout", "{} description", "products", "product_id", "name", "description"),
):
    _entity(key, which, text, *of)


def _count(key: str, which: str, text: str, table: str, column: str, values: list, qtype: str = "count") -> None:
    @template(key, qtype, which)
    def make(shop, rng):
        v = rng.choice(values)
        return {"text": text.format(v), "scalar": sum(r[column] == v for r in shop.dicts(table))}


_count("status", "dev", "How many orders have the status '{}'?", "orders", "status", STATUSES)
_count("segment", "dev", "How many customers are in the {} segment?", "customers", "segment", SEGMENTS)
_count("channel", "heldout", "Number of orders with channel '{}'", "orders", "channel", CHANNELS)
_count("category", "heldout", "Give the number of products with category '{}'", "products", "category", list(CATEGORIES))
_count("both", "dev", "Count of products with category '{}'", "products", "category", list(CATEGORIES), "filter")


def _numeric(key: str, which: str, text: str, table: str, column: str, by: str, values: list, how: Callable) -> None:
    @template(key, "numeric", which)
    def make(shop, rng):
        v = rng.choice(values)
        found = [r[column] for r in shop.dicts(table) if r[by] == v and r[column] is not None]
        return {"text": text.format(v), "scalar": how(found), "kind": "float"}


mean = lambda x: sum(x) / len(x)
_numeric("mean_price", "dev", "What is the average unit price of products with category '{}'?", "products", "unit_price", "category", list(CATEGORIES), mean)
_numeric("top_price", "dev", "What is the highest unit price of products with category '{}'?", "products", "unit_price", "category", list(CATEGORIES), max)
_numeric("credit", "heldout", "What is the total credit limit of customers in the {} segment?", "customers", "credit_limit", "segment", SEGMENTS, sum)
_numeric("low_credit", "heldout", "What is the lowest credit limit of customers in the {} segment?", "customers", "credit_limit", "segment", SEGMENTS, min)

MONTHS = "January February March April May June July August September October November December".split()


@template("month", "date", "dev")
def _month(shop, rng):
    y, m = rng.choice((2023, 2024)), rng.randrange(12)
    return {"text": f"How many orders were placed in {MONTHS[m]} {y}?", "scalar": sum((r["order_date"].year, r["order_date"].month) == (y, m + 1) for r in shop.dicts("orders"))}


@template("between", "date", "heldout")
def _between(shop, rng):
    a, b = sorted(r["order_date"] for r in rng.sample(shop.dicts("orders"), 2))
    return {"text": f"How many orders were placed between {a} and {b}?", "scalar": sum(a <= r["order_date"] <= b for r in shop.dicts("orders"))}


@template("orders_of_segment", "join", "dev")
def _orders_of_segment(shop, rng):
    v = rng.choice(SEGMENTS)
    own = {r["customer_id"] for r in shop.dicts("customers") if r["segment"] == v}
    return {"text": f"How many orders were placed by customers in the {v} segment?", "scalar": sum(r["customer_id"] in own for r in shop.dicts("orders")), "route": "hybrid"}


@template("quantity_of_category", "join", "heldout")
def _quantity_of_category(shop, rng):
    v = rng.choice(list(CATEGORIES))
    own = {r["product_id"] for r in shop.dicts("products") if r["category"] == v}
    return {"text": f"What is the total quantity of order items of products with category '{v}'?", "scalar": sum(r["quantity"] for r in shop.dicts("order_items") if r["product_id"] in own), "route": "hybrid"}


@template("columns", "schema", "dev", 5)
def _columns(shop, rng):
    t = rng.choice(list(shop.rows))
    return {"text": f"What columns does the {t} table have?", "rows": [f"{t}:"]}


@template("fields", "schema", "heldout", 5)
def _fields(shop, rng):
    t = rng.choice(list(shop.rows))
    return {"text": f"Describe the schema of {t}", "rows": [f"{t}:"]}


def _wrong(key: str, which: str, text: str, values: list[str]) -> None:
    @template(key, "distractor", which, len(values))
    def make(shop, rng):
        return {"text": text.format(rng.choice(values)), "answerable": False}


_wrong("no_status", "dev", "How many orders have the status '{}'?", ["refunded", "archived", "disputed", "queued", "parked", "expired"])
_wrong("no_attribute", "dev", "What is the {} of customer Ada Alder?", ["shoe size", "passport number", "blood type", "birthplace"])
_wrong("no_date", "heldout", "How many orders were placed between {}-01-01 and {}-12-31?".replace("{}-12", "2039-12"), ["2031", "2032", "2033", "2034"])
_wrong("no_entity", "heldout", "How many {} are there?", ["warehouses", "suppliers", "drivers", "invoices", "branches"])


def build(shop: Shop, sets: tuple[str, ...] = ("dev",), seed: int = 7) -> list[Question]:
    """The questions of the given sets; a text is asked once."""
    out: dict[str, Question] = {}
    for t in TEMPLATES:
        if t.set not in sets:
            continue
        rng = random.Random(zlib.crc32(f"{seed}:{t.key}".encode()))
        for k in range(t.n):
            made = t.make(shop, rng)
            lookup = t.qtype in ("entity", "schema")
            route = made.get("route", "lookup" if lookup else "aggregate")
            q = Question(f"{t.set}-{t.key}-{k}", made["text"], t.qtype, t.key, t.set, route, made.get("answerable", True), tuple(made.get("rows", ())), made.get("scalar"), made.get("kind", "int"))
            out.setdefault(q.text, q)
    return list(out.values())


def frame(spark: SparkSession, questions: list[Question]) -> DataFrame:
    rows = [(q.qid, q.text, q.qtype, q.template_set, q.route, q.answerable, None if q.scalar is None else float(q.scalar), q.kind) for q in questions]
    return spark.createDataFrame(rows, "qid string, text string, qtype string, template_set string, expected_route string, answerable boolean, gold double, kind string")


def gold_rows(spark: SparkSession, questions: list[Question]) -> DataFrame:
    return spark.createDataFrame([(q.qid, r) for q in questions for r in q.rows], "qid string, key string")


def sample(questions: list[Question], per_type: int) -> list[Question]:
    """The first of each type by the hash of their ids: the same ones every time."""
    by: dict[str, list[Question]] = {}
    for q in sorted(questions, key=lambda q: (zlib.crc32(q.qid.encode()), q.qid)):
        by.setdefault(q.qtype, []).append(q)
    return [q for t in TYPES for q in by.get(t, [])[:per_type]]



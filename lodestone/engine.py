"""The facade: ingest tables, retrieve chunks, answer questions with citations or refuse."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import GenerationConfig, MetadataFilter, RetrievalConfig
from lodestone.errors import CitationError, LodestoneError, PlanError
from lodestone.operators import answer as A
from lodestone.operators import chunks as C
from lodestone.operators import index as I
from lodestone.operators import profile as P
from lodestone.operators import retrieve as R
from lodestone.operators import store
from lodestone.operators.stage import scratch, staged
from lodestone.plans import planner
from lodestone.plans.guard import QueryResult, execute_readonly, guard
from lodestone.plans.lexicon import ISO, Lexicon
from lodestone.sources.base import Source
from lodestone.sources.catalog import Catalog

MAX_SQL_ROWS = 25
#: Planned aggregates that one job computes.
JOB_PLANS = 16


@dataclass(frozen=True)
class Answer:
    text: str
    refused: bool
    reason: str
    route: str
    value: object = None
    sql: str | None = None
    citations: list = field(default_factory=list)
    trace: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.refused and not self.citations:
            raise CitationError("an answer needs a citation")


def refusal(reason: str, route: str, **trace) -> Answer:
    return Answer("", True, reason, route, trace=trace)


class Engine:
    """Ingest, retrieval and answers over any source of tables."""

    def __init__(self, catalog: Source, embedder: str = "hashing"):
        self.catalog, self.spark = catalog, catalog.spark
        self.embedder, self.embed = embedder, I.get_embedder(embedder)
        self.index: dict[str, DataFrame] = {}
        self._lexicon: Lexicon | None = None
        self._mark, self._words, self._path = "", None, None

    # Profiles

    def profiles(self, tables: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Profiles and vocabularies of tables, as two tables."""
        profiled = vocab = None
        for t in tables or self.catalog.tables():
            own = self.catalog.table(t)
            df = self.catalog.data(t)
            p = P.profile(df, t, own.key, own.refs).persist()
            c = P.categories(df, p)
            profiled = p if profiled is None else profiled.unionByName(p)
            vocab = c if vocab is None else vocab.unionByName(c)
        return profiled, vocab

    def lexicon(self, tables: list[str] | None = None) -> Lexicon:
        """The words of the given tables (all, at first); read again when the data have changed."""
        mark = self.catalog.fingerprint()
        if self._lexicon is None or self._mark != mark:
            self._words = tables or self._words or self.catalog.tables()
            frames = {t: self.catalog.data(t) for t in self._words}
            declared = {t: (self.catalog.table(t).key, self.catalog.table(t).refs) for t in frames}
            self._lexicon, self._mark = Lexicon.build(self.catalog, *P.survey(frames, declared)), mark
        return self._lexicon

    # Ingest

    def chunk(self, tables: list[str], config: C.ChunkConfig = C.ChunkConfig()) -> DataFrame:
        """Schema cards and row chunks of tables as one lazy table."""
        profiled, vocab = self.profiles(tables)
        parts = []
        if config.cards:
            columns = self.spark.createDataFrame([(t, x["name"], i, x["type"], x["is_key"], x["nullable"], x["references"]) for t in tables for i, x in enumerate(self.catalog.schema(t))], "`table` string, `column` string, ord int, type string, is_key boolean, nullable boolean, ref string")
            parts.append(C.schema_cards(profiled, vocab, columns, self.catalog.source_id))
        if config.rows:
            roles: dict[str, dict[str, str]] = {}
            for r in profiled.select("table", "column", "role").collect():
                roles.setdefault(r["table"], {})[r["column"]] = r["role"]
            for t in tables:
                own = self.catalog.table(t)
                df = self.catalog.rows(t)
                if config.max_rows is not None:
                    df = df.limit(config.max_rows)
                parts.append(C.row_chunks(C.row_text(df, t, own.key, roles.get(t, {}), own.refs, config), t, self.catalog.source_id, config))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tables_of(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """What an index holds of chunks."""
        return {"chunks": chunks, "postings": I.postings(chunks), "stats": I.doc_stats(chunks), "vectors": self.embed(chunks)}

    def ingest(self, tables: list[str], config: C.ChunkConfig = C.ChunkConfig(), path: str | None = None) -> dict[str, int]:
        """Indexes what is new or changed of these tables and drops what is gone; returns counts by action.

        Equal content isn't embedded again, and other tables stay as they are. With a path, what is there already is the
        index that is added to, whatever this engine holds; only new rows and the ids of replaced ones are written. Without
        one the index lives as long as the session.
        """
        if path is None:
            path = self._path = self._path or scratch(self.spark)
        if store.manifest(self.spark, path):
            self.open(path)
        else:
            self.index = {}
        new = staged(self.chunk(tables, config))
        stored = self.index["chunks"].where(F.col("table").isin(*tables) & (F.col("source_id") == self.catalog.source_id)) if self.index else self.spark.createDataFrame([], new.schema)
        moves = staged(I.diff(stored, new))
        counts = {r["action"]: r["count"] for r in moves.groupBy("action").count().collect()}
        if set(counts) - {"skip"} or not self.index:
            fresh = staged(new.join(moves.where(F.col("action").isin("insert", "update")).select("chunk_id"), "chunk_id", "left_semi"))
            store.commit(self.spark, path, self.tables_of(fresh), moves.where(F.col("action").isin("update", "delete")).select("chunk_id"))
            self.open(path)
        return {a: counts.get(a, 0) for a in ("insert", "update", "skip", "delete")}

    def open(self, path: str) -> None:
        """The newest version of the index at a path."""
        _, self.index = store.load(self.spark, path)

    # Retrieval and answers

    def retrieve(self, questions: DataFrame, config: RetrievalConfig = RetrievalConfig(), where: MetadataFilter = MetadataFilter()) -> DataFrame:
        return R.retrieve(questions, self.index, config, where, self.embed)

    def run_sql(self, question: str) -> tuple[planner.AggPlan, str, QueryResult]:
        """Plans a question and runs it as a guarded query over the catalog's tables."""
        lex = self.lexicon()
        p = planner.plan(question, lex)
        sql = planner.to_sql(p)
        for t in p.tables():
            self.catalog.data(t).createOrReplaceTempView(t)
        return p, sql, execute_readonly(self.spark, sql, tables=set(p.tables()))

    def ask(self, question: str, retrieval: RetrievalConfig = RetrievalConfig(), generation: GenerationConfig = GenerationConfig()) -> Answer:
        """One question: a computed value or retrieved evidence, cited, or a refusal."""
        return self.ask_many([question], retrieval, generation)[0]

    def ask_many(self, questions: list[str], retrieval: RetrievalConfig = RetrievalConfig(), generation: GenerationConfig = GenerationConfig()) -> list[Answer]:
        """Many questions: those that look something up share one batch of retrieval; computed values share jobs."""
        lex = self.lexicon()
        out: dict[int, Answer] = {}
        routes, plans, lookups = {}, {}, []
        for n, q in enumerate(questions):
            route = routes[n] = planner.classify(q, lex)
            if refused := self._refuses(q, route, lex):
                out[n] = refusal(refused, route.name)
            elif route.name == "lookup":
                lookups.append(n)
            else:
                try:
                    p = planner.plan(q, lex)
                    sql = planner.to_sql(p)
                    self._views(p)
                    guard(self.spark, sql, set(p.tables()))
                    plans[n] = (p, sql)
                except LodestoneError as e:  # expected: a question that can't be planned
                    self._give_up(n, e, routes, lookups, out)
        for n, result in self._computed(plans):
            sql = plans[n][1]
            if isinstance(result, Exception):
                self._give_up(n, result, routes, lookups, out)
            elif len(result.rows) <= 1 and len(result.columns) == 1 and result.scalar is None:
                out[n] = refusal("undefined_value", routes[n].name, sql=sql)
            else:
                citation = sql_chunk(sql, result)
                value = result.scalar if len(result.columns) == 1 else result.rows
                out[n] = Answer(f"{result.scalar if len(result.columns) == 1 else citation['text']} [1]", False, "", routes[n].name, value, sql, [citation])
        if lookups and not self.index:
            out |= {n: refusal("no_index", routes[n].name) for n in lookups}
        elif lookups:
            asked = self.spark.createDataFrame([(n, questions[n]) for n in lookups], "qid int, text string")
            for found in self.answer_batch(asked, retrieval, generation).collect():
                n = found["qid"]
                out[n] = refusal(found["reason"], routes[n].name) if found["refused"] else Answer(found["text"], False, "", routes[n].name, citations=[c.asDict() for c in found["citations"]])
        return [out[n] for n in range(len(questions))]

    def _refuses(self, question: str, route, lex: Lexicon) -> str | None:
        """Why a question can't be answered from these tables, before anything is run."""
        if route.schema_question:
            return None
        if bad := lex.unresolved_attributes(question):
            return f"unknown_attribute: {bad[0]}"
        if bad := lex.unknown_entities(question):
            return f"unknown_entity: {bad[0]}"
        days = sorted(ISO.findall(question))
        return "date_outside_data" if days and lex.outside_data(days[0], days[-1]) else None

    def _give_up(self, n: int, error: Exception, routes, lookups: list[int], out: dict[int, Answer]) -> None:
        """What can't be computed is looked up if several tables are named; else it's refused with the reason."""
        if routes[n].name == "hybrid" and self.index:
            lookups.append(n)
        else:
            out[n] = refusal(f"{type(error).__name__}: {error}", routes[n].name)

    def _views(self, p: planner.AggPlan) -> None:
        for t in p.tables():
            self.catalog.data(t).createOrReplaceTempView(t)

    def _computed(self, plans: dict[int, tuple[planner.AggPlan, str]]):
        """(n, result or error) of planned aggregates. Single values are computed JOB_PLANS at a time, in one job."""
        single = [n for n, (p, _) in plans.items() if p.group is None]
        for k in range(0, len(single), JOB_PLANS):
            some = single[k : k + JOB_PLANS]
            by_type: dict[str, dict[int, DataFrame]] = {}
            for n in some:
                df = planner.to_frame(plans[n][0], self.lexicon())
                by_type.setdefault(df.schema["value"].dataType.simpleString(), {})[n] = df.select(F.lit(n).alias("n"), "value")
            for members in by_type.values():
                try:
                    rows = reduce(DataFrame.unionByName, members.values()).collect()
                except Exception:  # noqa: BLE001  a value that can't be compared, say: the question fails, not the batch
                    yield from self._one_by_one(members, plans)
                    continue
                for r in rows:
                    yield r["n"], QueryResult(("value",), [(r["value"],)], plans[r["n"]][1])
        yield from self._one_by_one([n for n, (p, _) in plans.items() if p.group is not None], plans)

    def _one_by_one(self, some, plans):
        for n in some:
            p, sql = plans[n]
            self._views(p)
            try:
                yield n, execute_readonly(self.spark, sql, tables=set(p.tables()))
            except Exception as e:  # noqa: BLE001
                yield n, e

    def answer_batch(self, questions: DataFrame, retrieval: RetrievalConfig = RetrievalConfig(), generation: GenerationConfig = GenerationConfig()) -> DataFrame:
        """Extractive answers of many questions: (qid, text, refused, reason, citations)."""
        found = staged(self.retrieve(questions, retrieval))  # k rows for each question
        hits = found.join(self.index["chunks"].select("chunk_id", "source_id", "kind", "table", "pk", "text"), "chunk_id")
        return A.answer(questions, hits, generation)

    def ask_batch(self, questions: list[str]) -> DataFrame:
        """(qid, route, value, sql, citation_chunk_id, refused, reason) of many questions."""
        rows = []
        for n, a in enumerate(self.ask_many(questions)):
            rows.append((n, a.route, None if a.refused else str(a.value if a.value is not None else a.text), a.sql, a.citations[0]["chunk_id"] if a.citations else None, a.refused, a.reason))
        return self.spark.createDataFrame(rows, "qid int, route string, value string, sql string, citation_chunk_id string, refused boolean, reason string")

    def close(self) -> None:
        self.index = {}
        self.catalog.close()


def sql_chunk(sql: str, result: QueryResult) -> dict:
    """What a computed value cites: the query and its rows."""
    if result.scalar is not None:
        text = f"{result.columns[0]} = {result.scalar}"
    else:
        text = "; ".join(", ".join(f"{c} = {v}" for c, v in zip(result.columns, r)) for r in result.rows[:MAX_SQL_ROWS])
    return {"chunk_id": "sql:" + hashlib.sha256(sql.encode()).hexdigest()[:32], "kind": "sql_result", "text": text, "sql": sql}


def flagship(spark: SparkSession, directory: str, question: str = "How many orders were there in 1995?") -> DataFrame:
    """One question end to end over the orders table: profile, lexicon, route, plan, guard, frame, citation."""
    engine = Engine(Catalog(spark, directory))
    lex = engine.lexicon(["orders"])
    route = planner.classify(question, lex)
    try:
        p = planner.plan(question, lex)
    except PlanError as e:
        return spark.createDataFrame([(0, route.name, None, None, None, True, str(e))], "qid int, route string, value long, sql string, citation_chunk_id string, refused boolean, reason string")
    sql = planner.to_sql(p)
    for t in p.tables():
        engine.catalog.load(t).createOrReplaceTempView(t)
    guard(spark, sql, set(p.tables()))
    cited = "sql:" + hashlib.sha256(sql.encode()).hexdigest()[:32]
    return planner.to_frame(p, lex).select(F.lit(0).alias("qid"), F.lit(route.name).alias("route"), "value", F.lit(sql).alias("sql"), F.lit(cited).alias("citation_chunk_id"), F.lit(False).alias("refused"), F.lit("").alias("reason"))

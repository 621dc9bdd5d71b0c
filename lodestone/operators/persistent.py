"""An index bound to a path: opened from what is there, and every change is stored before the call returns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import MetadataFilter
from lodestone.operators import index as I
from lodestone.operators import store
from lodestone.operators.stage import staged


class PersistentIndex:
    """Chunks with their postings, statistics and vectors. Tables stay in Spark; only point look-ups reach the driver."""

    def __init__(self, spark: SparkSession, path: str, embedder: str = "hashing"):
        self.spark, self.path, self.embed = spark, path, I.get_embedder(embedder)
        self.version, self.tables = 0, {}
        self.refresh()

    def refresh(self) -> None:
        """What others have stored since."""
        if store.manifest(self.spark, self.path):
            self.version, self.tables = store.load(self.spark, self.path)

    def _commit(self, new: DataFrame | None, gone: DataFrame | None) -> None:
        added = {} if new is None else {"chunks": new, "postings": I.postings(new), "stats": I.doc_stats(new), "vectors": self.embed(new)}
        store.commit(self.spark, self.path, added, gone)
        self.refresh()

    def upsert(self, chunks: DataFrame) -> int:
        """Adds chunks or replaces those of the same id; returns how many weren't there already with the same content."""
        new = staged(I.distinct_keys(chunks))
        if self.tables:
            same = self.tables["chunks"].select("chunk_id", "content_hash")
            new = staged(new.join(same, ["chunk_id", "content_hash"], "left_anti"))
        if n := new.count():
            self._commit(new, new.select("chunk_id"))
        return n

    def delete(self, ids: DataFrame) -> int:
        """Removes chunks by id; returns how many there were."""
        hit = staged(self.tables["chunks"].join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id")) if self.tables else None
        if hit is None or not (n := hit.count()):
            return 0
        self._commit(None, hit)
        return n

    def delete_by_source(self, source_id: str) -> int:
        return self.delete(self.tables["chunks"].where(F.col("source_id") == source_id)) if self.tables else 0

    def count(self) -> int:
        return self.tables["chunks"].count() if self.tables else 0

    def get(self, chunk_id: str) -> dict | None:
        row = self.tables["chunks"].where(F.col("chunk_id") == chunk_id).first() if self.tables else None
        return None if row is None else row.asDict(recursive=True)

    def vector_of(self, chunk_id: str) -> list[float] | None:
        row = self.tables["vectors"].where(F.col("chunk_id") == chunk_id).first() if self.tables else None
        return None if row is None else list(row["vector"])

    def iter_chunks(self) -> Iterator[dict]:
        """All chunks by id, one partition at a time on the driver."""
        for row in self.tables["chunks"].orderBy("chunk_id").toLocalIterator() if self.tables else ():
            yield row.asDict(recursive=True)

    def search(self, questions: DataFrame, k: int = 10, where: MetadataFilter = MetadataFilter(), lexical: bool = False) -> DataFrame:
        """(qid, chunk_id, score, rank) of questions (qid, text): by vectors, or by BM25. The filter comes before scores."""
        allowed = None if where.is_empty else self.tables["chunks"].where(where.column()).select("chunk_id")
        if lexical:
            return I.bm25(questions, self.tables["postings"], self.tables["stats"], k, allowed)
        vectors = self.tables["vectors"] if allowed is None else self.tables["vectors"].join(allowed, "chunk_id", "left_semi")
        return I.knn(self.embed(questions, key="qid").select(F.col("chunk_id").alias("qid"), "vector"), vectors, k)

"""Lexical and dense indexes as tables, their maintenance, and batch search over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.errors import ConfigError, IndexError_
from lodestone.functions import text as X
from lodestone.operators import scan as S
from lodestone.operators.scan import Best
from lodestone.operators.stage import bounded_batches
from lodestone.operators.store import commit, load  # noqa: F401  the index as a whole

DIM = 384
#: Questions of one matrix product, and of one broadcast: 16,384 vectors of 384 numbers are 50 MB.
QUERY_BLOCK, BROADCAST_QUESTIONS = 1024, 16_384
#: Vectors of one matrix product.
VECTOR_BLOCK = 1024


def top(df: DataFrame, k: int, by: str = "score", part: str = "qid", tie: str = "chunk_id") -> DataFrame:
    """The k best of each part with their rank; Spark plans this as a group limit before the shuffle."""
    order = W.partitionBy(part).orderBy(F.col(by).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# Lexical


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, chunk_id, tf); empty texts have no rows."""
    return chunks.select(F.col(key).alias("chunk_id"), F.explode(X.words(F.col(text))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, dl): every chunk with its number of words."""
    return chunks.select(F.col(key).alias("chunk_id"), F.size(X.words(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("dl"))


def doc_freq(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: n, avgdl, vocab."""
    vocab = posted.select("term").distinct().agg(F.count("*").alias("vocab"))
    return stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).crossJoin(vocab)  # one row each


def bm25(questions: DataFrame, posted: DataFrame, stats: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank). N, document frequencies and lengths are of the whole index; `allowed` (chunk_id)
    only restricts candidates, before anything is ranked. Where nothing is stored, `scan.count_texts` takes texts."""
    return S.bm25(S.count_postings(questions, posted, stats), k, allowed=allowed)


# Dense


def grams(text: Column) -> Column:
    """Character 3- to 5-grams of each ^word$, and the words themselves."""

    def of(word: Column) -> Column:
        edged = F.concat(F.lit("^"), word, F.lit("$"))
        ngrams = [_ngrams(edged, n) for n in (3, 4, 5)]
        return F.concat(*ngrams, F.array(F.concat(F.lit("w:"), word)))

    return F.flatten(F.transform(X.words(text), of))


def _ngrams(edged: Column, n: int) -> Column:
    return F.when(F.length(edged) >= n, F.transform(F.sequence(F.lit(1), F.length(edged) - (n - 1)), lambda i: F.substring(edged, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def hashed(chunks: DataFrame, key: str = "chunk_id", text: str = "text", dim: int = DIM) -> DataFrame:
    """(chunk_id, bucket, weight): signed feature hashing of the grams, from a digest that any engine has."""
    found = chunks.select(F.col(key).alias("chunk_id"), F.explode(grams(F.col(text))).alias("g")).withColumn("d", F.md5(F.col("g").cast("binary")))
    bucket = (F.conv(F.substring("d", 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring("d", 9, 1), 16, 10).cast("int") >= 8, -1).otherwise(1)
    return found.groupBy("chunk_id", bucket.alias("bucket")).agg(F.sum(sign).cast("double").alias("weight")).where("weight <> 0")


def embed(chunks: DataFrame, key: str = "chunk_id", text: str = "text", dim: int = DIM) -> DataFrame:
    """(chunk_id, vector): the cells of `hashed`, of unit length; a chunk without words has a zero vector.

    One narrow pass: grams are digested once for each distinct word of a worker, and a text is the sum of its words.
    """
    bounded_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(dim)
        for batch in batches:
            lists = batch.column("words")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            sums = cells.sums(coded.dictionary.to_pylist(), np.repeat(np.arange(batch.num_rows), lengths), coded.indices.to_numpy(zero_copy_only=False), batch.num_rows)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))  # of whole numbers, so in any order
            unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], ["chunk_id", "vector"])

    rows = chunks.select(F.col(key).alias("chunk_id"), X.words(F.col(text)).alias("words"))
    return rows.mapInArrow(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, vector array<double>")


class _Known(dict):
    """What a function gives, by key; emptied by its owner."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, key):
        self[key] = found = self.of(key)
        return found


class _Cells:
    """Sums of the signed grams of texts. Grams and words seen are kept, up to MOST of each.

    A cell is twice a gram's bucket, and one more where its sign is minus. Grams are numbers of up to five letters of
    BITS bits; letters are numbered as they come.
    """

    MOST, PAIRS, WORDS, BITS = 300_000, 20_000, 20_000, 12

    def __init__(self, dim: int):
        self.dim, self.grams, self.whole = dim, _Known(self._gram), _Known(lambda word: self._digested("w:" + word))
        self.number, self.letters = np.zeros(0x110000, np.int64), [""]

    def _digested(self, gram: str) -> int:
        d = md5(gram.encode()).digest()
        return int.from_bytes(d[:4], "big") % self.dim * 2 + (d[4] >= 128)

    def _gram(self, key: int) -> int:
        letters = []
        while key:
            letters.append(self.letters[key & (1 << self.BITS) - 1])
            key >>= self.BITS
        return self._digested("".join(reversed(letters)))

    def _numbers(self, points: np.ndarray) -> np.ndarray | None:
        """The letters' numbers; None if there are too many letters for BITS."""
        for _ in range(2):
            new = np.unique(points[self.number[points] == 0])
            if len(self.letters) + len(new) <= 1 << self.BITS:
                self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
                self.letters += map(chr, new)
                return self.number[points]
            self.grams.clear()
            self.number[:], self.letters = 0, [""]
        return None

    def cells(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cells, word by word; how many of each word)."""
        for kept in (self.grams, self.whole):
            if len(kept) > self.MOST:
                kept.clear()
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        own = np.repeat(np.arange(len(words)), size)
        letters = self._numbers(np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32))
        if letters is None:
            found = [[self._digested(e[i : i + n]) for e in (f"^{w}$",) for n in (3, 4, 5) for i in range(len(e) - n + 1)] + [self.whole[w]] for w in words]
            return np.array([c for f in found for c in f], np.int32), np.array([len(f) for f in found])
        many = np.stack([size - 2, np.maximum(size - 3, 0), np.maximum(size - 4, 0), np.ones_like(size)])  # grams of 3, 4, 5 letters, and the word
        length, start = many.sum(axis=0), np.cumsum(size) - size
        place = np.cumsum(length) - length + np.cumsum(many, axis=0) - many
        keys, at = [], []
        for n in (3, 4, 5):
            within = np.flatnonzero(own[: 1 - n] == own[n - 1 :]) if len(own) >= n else np.zeros(0, np.int64)
            key = letters[within]
            for i in range(1, n):
                key = key << self.BITS | letters[within + i]
            keys.append(key)
            at.append((place[n - 3] - start)[own[within]] + within)
        coded = pa.array(np.concatenate(keys)).dictionary_encode()
        distinct = np.fromiter(map(self.grams.__getitem__, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        flat = np.empty(length.sum(), np.int32)
        flat[np.concatenate(at)] = distinct[coded.indices.to_numpy(zero_copy_only=False)]
        flat[place[3]] = np.fromiter(map(self.whole.__getitem__, words), np.int32, len(words))
        return flat, length

    def sums(self, words: list[str], row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
        """words: distinct ones; row and code of each word of the texts, by row."""
        out = np.zeros((rows, self.dim))
        if not words:
            return out
        flat, length = (np.concatenate(x) for x in zip(*(self.cells(words[i : i + self.WORDS]) for i in range(0, len(words), self.WORDS))))
        first = np.cumsum(length) - length
        pair, times = np.unique(row * len(words) + code, return_counts=True)
        for start in range(0, len(pair), self.PAIRS):
            r, c = np.divmod(pair[start : start + self.PAIRS], len(words))
            n = length[c]
            at = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            low, high = int(r[0]), int(r[-1]) + 1
            cell = np.repeat((r - low) * self.dim, n) + (flat[at] >> 1)
            signed = np.repeat(times[start : start + self.PAIRS], n) * (1 - 2 * (flat[at] & 1))
            out[low:high] += np.bincount(cell, signed, (high - low) * self.dim).reshape(high - low, self.dim)
        return out


def normalized(vector: Column) -> Column:
    """To unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def knn(questions: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(qid, chunk_id, score, rank): exact nearest neighbours by dot product.

    A partition of vectors multiplies them with all questions, VECTOR_BLOCK by QUERY_BLOCK at a time, keeps a running best
    of k for each question, and sends on only these. Questions are a stated set: they're broadcast if there are at most
    BROADCAST_QUESTIONS, else block by block as a scan of the vectors each.
    """
    key = vectors.schema["chunk_id"].dataType.simpleString()
    empty = questions.sparkSession.createDataFrame([], f"qid {questions.schema['qid'].dataType.simpleString()}, chunk_id {key}, score double, rank int")
    if k <= 0:
        return empty
    bounded_batches(vectors.sparkSession)
    parts = [_knn_block(block, questions, vectors, k, key) for block in _blocks(questions)]
    return reduce(DataFrame.unionByName, parts) if parts else empty


def _blocks(questions: DataFrame) -> Iterator[list]:
    block: list = []
    for row in questions.select("qid", "vector").toLocalIterator():
        block.append((row[0], np.asarray(row[1], np.float64)))
        if len(block) == BROADCAST_QUESTIONS:
            yield block
            block = []
    if block:
        yield block


def _knn_block(block: list, questions: DataFrame, vectors: DataFrame, k: int, key: str) -> DataFrame:
    dims = {len(v) for _, v in block}
    if len(dims) != 1:
        raise IndexError_("vectors of different lengths")
    dim = dims.pop()
    shared = vectors.sparkSession.sparkContext.broadcast(np.stack([v for _, v in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best, kind = Best(len(q), k), None
        for whole in batches:
            for start in range(0, whole.num_rows, VECTOR_BLOCK):
                part = whole.slice(start, VECTOR_BLOCK)
                kind, lists = part.column("chunk_id").type, part.column("vector")
                if wrong := {n for n in pc.unique(pc.list_value_length(lists)).to_pylist() if n != dim}:
                    raise ValueError(f"vectors have {wrong.pop()} dimensions, questions {dim}")
                m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                ids = part.column("chunk_id").to_numpy(zero_copy_only=False)
                for first in range(0, len(q), QUERY_BLOCK):
                    scores = q[first : first + QUERY_BLOCK] @ m.T
                    best.add(first, np.round(scores, 6, out=scores), ids)
        yield from best.batches(kind)

    found = vectors.select("chunk_id", "vector").mapInArrow(run, f"n int, chunk_id {key}, score double")
    return S.ranked(found, [qid for qid, _ in block], questions.schema["qid"].dataType.simpleString(), k)


# Maintenance: tables are immutable, so every change is a new version


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """New rows replace stored ones of the same key; of repeated new keys the last by `order` counts, else the greatest by content."""
    new = distinct_keys(new, key, order)
    if order is not None:
        new = new.drop(order)
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def distinct_keys(rows: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """One row for each key: the last by `order`; without one the greatest by what it holds, the same one every time."""
    by = order or ("content_hash" if "content_hash" in rows.columns else None)
    last = W.partitionBy(key).orderBy(F.col(by).desc() if by else F.xxhash64(*rows.columns))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def delete(stored: DataFrame, ids: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, int]:
    """What is left, and how many stored rows the ids hit (repeated ids count once)."""
    return stored.join(ids.select(key), key, "left_anti"), stored.join(ids.select(key), key, "left_semi").count()


def delete_by_source(stored: DataFrame, source_id: str) -> tuple[DataFrame, int]:
    return stored.where(F.col("source_id") != source_id), stored.where(F.col("source_id") == source_id).count()


def diff(stored: DataFrame, new: DataFrame, key: str = "chunk_id", digest: str = "content_hash") -> DataFrame:
    """(key, action): insert, update, skip or delete, from one full outer join."""
    a, b = stored.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(F.col("__old") == F.col("__new"), "skip").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


EMBEDDERS = {"hashing": embed}
#: Why the embedder asked for isn't the one in use.
FALLBACK_REASON: dict[str, str] = {}


def get_embedder(name: str = "auto"):
    """An embedder by name; `auto` and learned ones fall back to hashing here, and that is recorded."""
    if name in EMBEDDERS:
        return EMBEDDERS[name]
    if name in ("auto", "local", "remote"):
        FALLBACK_REASON[name] = "no learned model is available offline"
        return embed
    raise ConfigError(f"unknown embedder: {name}")

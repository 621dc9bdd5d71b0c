"""Toxicity scoring with a factorization machine over hashed terms.

A text is the set of its lower-cased words and of their beginnings (so that inflected forms share a term),
hashed into 2**HASH_BITS buckets, of which only those that learned anything are stored. The score is
sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the buckets present: the pair terms are what an additive
model misses. Buckets whose presence doesn't depend on the label in the training sample get no weight, so
the many other words of a long text add no noise. Null and empty texts score as texts without any known
term. With no usable label of both classes, or empty tables, the model is constant (the base rate). Equal texts
get equal scores, rows that repeat an id are scored each for itself, and labels that repeat an id all count. A text
whose score is exactly THRESHOLD is predicted toxic. Other columns stay, but for those of the names that are added.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_batches, crc_mod, text_or_empty

#: At most so many labelled rows are learned from (those of the smallest hash of their id).
TRAIN_ROWS = 6_000
HASH_BITS, FACTORS = 30, 6
#: Lengths of the word beginnings that are terms too.
STEMS = (4, 5)
#: Buckets that learn: those whose label association has a z score of Z_LEAST or more, seen in one of SEEN_SHARE texts
#: at least (and in three).
Z_LEAST, SEEN_SHARE = 5.0, 1000
#: A toxic text weighs as much as so many others.
POSITIVE_WEIGHT = 4.0
EPOCHS, RATE, DECAY, SEED = 40, 0.2, 1e-4, 7
THRESHOLD = 0.3
CACHE_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def word_buckets(word: str) -> list[int]:
    """The buckets of a word and of its beginnings."""
    return [bucket(word), *(bucket("^" + word[:n]) for n in STEMS if len(word) >= n)]


def terms(text: str | None) -> set[int]:
    """The hash buckets of the distinct words of a whole text."""
    return {b for w in set(WORD.findall((text or "").lower())) for b in word_buckets(w)}


@dataclass
class Machine:
    """Weights of the buckets that learned; all others are zero."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def __call__(self, rows) -> float:
        z = self.logit(np.asarray(rows, dtype=np.int64))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Adaptive gradient descent on the log loss. rows: the buckets of each text; labels: 0 or 1.

    Texts of the same set of buckets are copies of each other and count once, else the chance words of a much copied
    text would look like signals. The bias stays at the base rate, so a text without any
    known term scores as the base rate and one strong term alone can pass the threshold.
    """
    once = {(hashlib.sha256(np.asarray(r, np.int64).tobytes()).digest(), y): k for k, (r, y) in reversed(list(enumerate(zip(rows, labels))))}
    rows, labels = [rows[k] for k in sorted(once.values())], labels[sorted(once.values())]
    n, positive = len(labels), float(labels.sum())
    rate = min(max(positive / n if n else 0.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    if not 0 < positive < n:
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, FACTORS)))
    # Counts of all terms take one sorted copy of them; only chosen terms get places of their own.
    flat = np.concatenate(rows) if n else np.empty(0, np.int32)
    found, seen = np.unique(flat, return_counts=True)
    del flat
    toxic, times = np.unique(np.concatenate([r for r, y in zip(rows, labels) if y]), return_counts=True)
    hits = np.zeros(len(found))
    hits[np.searchsorted(found, toxic)] = times
    z = (hits - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
    z[seen < max(3, n / SEEN_SHARE)] = 0
    chosen = found[np.abs(z) >= Z_LEAST]
    own = [np.flatnonzero(np.isin(chosen, r)) for r in rows]
    at, flat = np.repeat(np.arange(n), [len(o) for o in own]), np.concatenate(own)
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS))
    gw, gv = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
    ends = np.searchsorted(at, np.arange(n + 1))
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
            spans = [np.arange(ends[i], ends[i + 1]) for i in batch]
            own = np.repeat(np.arange(len(batch)), [len(s) for s in spans])
            f = flat[np.concatenate(spans)] if len(own) else np.empty(0, np.int64)
            total = np.zeros((len(batch), FACTORS))
            np.add.at(total, own, v[f])
            logit = bias + np.bincount(own, weights=w[f], minlength=len(batch)) + 0.5 * ((total**2).sum(1) - np.bincount(own, weights=(v[f] ** 2).sum(1), minlength=len(batch)))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch) * np.where(labels[batch] > 0, POSITIVE_WEIGHT, 1.0)
            dw = np.bincount(f, weights=error[own], minlength=len(w)) + DECAY * w
            dv = DECAY * v
            np.add.at(dv, f, error[own][:, None] * (total[own] - v[f]))
            gw += dw**2
            gv += dv**2
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * 0.2 * dv / np.sqrt(gv)
    return Machine(chosen, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Machine:
    """Learns from at most `limit` labelled rows. docs: doc_id, text; labels: doc_id, toxic (null labels are left out)."""
    picked = labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(terms(t)))

    # The sample is bounded by `limit`, so it may be broadcast; ids that repeat don't make it larger.
    some = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "__y", F.xxhash64("text").alias("h"), run(text_or_empty()).alias("x"))
    found = some.orderBy(F.xxhash64("doc_id"), "doc_id", "h", "__y").limit(limit).select("__y", "x").toPandas()
    return fit([np.asarray(x, dtype=np.int32) for x in found["x"]], found["__y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """Adds score (double) and predicted (int); one narrow pass over whole texts."""
    arrow_batches(docs.sparkSession)
    index = {int(b): k for k, b in enumerate(model.buckets)}

    class Known(dict):
        def __missing__(self, word: str) -> tuple[int, ...]:
            if len(self) >= CACHE_WORDS:
                self.clear()
            found = tuple(index[b] for b in word_buckets(word) if b in index)
            if len(word) < 64:
                self[word] = found
            return found

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known()
        for texts in batches:
            yield pd.Series([model(sorted({k for found in filter(None, map(known.__getitem__, set(WORD.findall(t.lower())))) for k in found})) for t in texts], dtype="float64")

    value = run(text_or_empty(text)).alias("score")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*keep, value)
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))


def held_out(column: str = "doc_id"):
    """The fold that is never learned from."""
    return crc_mod(column, 4) == 2

"""Benchmark decontamination by winnowing.

Training texts and test items are word sequences (A-Z lowered). Of every WINDOW = SPAN - GRAM + 1
neighbouring GRAM-word hashes the smallest is kept as a fingerprint, so any shared run of SPAN words shares
one. Fingerprints of training texts are joined with those of the items; a hit is extended to the words
around it, compared as words, and every SPAN-word window of an item that really occurs is marked in the
text. Items of fewer than SPAN words are one window of their own length; their fingerprint is the hash of
their whole sequence, probed at every position of a text.

The items are the small side: they're held in blocks of BLOCK_CHARS characters, each a broadcast of bounded
size, and a benchmark of any size is worked off block by block; the hits of a text are merged afterwards. A
null or wordless text has no words and no hits; a null or wordless item never occurs; equal items all count. Equal
texts have equal hits, whatever their ids; other columns stay, but for those of the names that are added.
"""

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_batches, free_name, text_or_empty
from lodestone.llm.grams import WordHash, grams, hashes, winnow

SPAN, GRAM = 10, 5
#: Characters of items that one pass holds in a Python worker.
BLOCK_CHARS = 8 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    """Lower-cases A-Z only; other letters stay as they are."""
    text = text or ""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes know no other case


class Index:
    """The windows of a block of items, and their fingerprints."""

    def __init__(self, items: list[tuple[str, str]]):
        self.known = WordHash()
        self.windows: dict[tuple[str, ...], set[str]] = defaultdict(set)
        prints, short = set(), defaultdict(set)
        for item, text in items:
            found = words(text)
            if not found:
                continue
            h = hashes(self.known, found)
            if len(found) < SPAN:
                short[len(found)].add(int(grams(h, len(found))[0]))
                self.windows[tuple(found)].add(item)
                continue
            for k in range(len(found) - SPAN + 1):
                self.windows[tuple(found[k : k + SPAN])].add(item)
            g = grams(h, GRAM)
            prints.update(g[winnow(g, SPAN - GRAM + 1)].tolist())
        self.prints = np.array(sorted(prints), np.uint64)
        self.short = {n: np.array(sorted(v), np.uint64) for n, v in short.items()}

    @staticmethod
    def hits(g: np.ndarray, prints: np.ndarray) -> np.ndarray:
        if not len(prints) or not len(g):
            return np.empty(0, np.int64)
        k = np.searchsorted(prints, g)
        k[k == len(prints)] = 0
        return np.flatnonzero(prints[k] == g)

    def find(self, text: str) -> tuple[int, list[int], list[int], set[str]]:
        """Number of words; starts and ends of the hit runs; the items with occurring windows."""
        found = words(text)
        n = len(found)
        if not n:
            return 0, [], [], set()
        h = hashes(self.known, found)
        starts: dict[int, int] = {}
        items: set[str] = set()

        def probe(at: int, size: int) -> None:
            if 0 <= at <= n - size and (got := self.windows.get(tuple(found[at : at + size]))):
                items.update(got)
                starts[at] = max(starts.get(at, 0), size)

        g = grams(h, GRAM)
        if len(self.prints) and len(g):
            at = winnow(g, SPAN - GRAM + 1) if n >= SPAN else np.empty(0, np.int64)
            around: set[int] = set()
            for p in at[self.hits(g[at], self.prints)].tolist():
                around.update(range(p - SPAN + GRAM, p + 1))
            for p in around:
                probe(p, SPAN)
        for size, prints in self.short.items():
            for p in self.hits(grams(h, size), prints).tolist():
                probe(p, size)
        first, last = [], []
        for at in sorted(starts):
            if last and at <= last[-1]:
                last[-1] = max(last[-1], at + starts[at])
            else:
                first.append(at)
                last.append(at + starts[at])
        return n, first, last, items


def blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_INDEX: dict = {}


def _index(token: int, items: list[tuple[str, str]]) -> Index:
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = Index(items)
    return _INDEX[token]


def _pass(docs: DataFrame, items: list[tuple[str, str]], name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    token = hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("n_words long, starts array<long>, ends array<long>, items array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _index(token, shared.value)
        for texts in batches:
            rows = [index.find(t) for t in texts]
            yield pd.DataFrame([(n, a, b, sorted(i)) for n, a, b, i in rows], columns=["n_words", "starts", "ends", "items"])

    return docs.withColumn(name, run(text_or_empty()))


def _runs_length(starts, ends):
    """Words in the union of runs given as two arrays."""
    pairs = F.array_sort(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))))
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(pairs, none, lambda a, p: F.struct(F.greatest(a["upto"], p["e"]).alias("upto"), (a["n"] + F.greatest(p["e"] - F.greatest(a["upto"], p["s"]), F.lit(0).cast("long"))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    One narrow pass for each block of items; with several blocks the hits of a text meet in one group by its digest:
    equal texts have equal hits, whatever their ids.
    """
    arrow_batches(docs.sparkSession)
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    hit, key = free_name(docs, "hit"), free_name(docs, "key")
    docs = docs.select(*own)
    parts = [_pass(docs, b, hit) for b in blocks(benchmark)] or [_pass(docs, [], hit)]
    found = parts[0]
    if len(parts) > 1:
        same, names = F.unhex(F.sha2(text_or_empty(), 256)), ("starts", "ends", "items")
        rest = parts[1].select(same.alias(key), hit)
        for p in parts[2:]:
            rest = rest.unionByName(p.select(same.alias(key), hit))
        rest = rest.where(F.size(f"{hit}.starts") > 0).groupBy(key).agg(F.collect_set(hit).alias("all"))  # copies of a text count once
        more = free_name(docs, "more")
        rest = rest.select(key, F.struct(*(F.flatten(F.col(f"all.{c}")).alias(c) for c in names)).alias(more))
        both = F.struct(F.col(f"{hit}.n_words").alias("n_words"), *(F.concat(f"{hit}.{c}", F.coalesce(f"{more}.{c}", F.expr("array()"))).alias(c) for c in names))
        found = found.join(rest, same == F.col(key), "left").select(*own, both.alias(hit))
    items = F.array_sort(F.array_distinct(f"{hit}.items"))
    return found.select(
        *own,
        F.col(f"{hit}.n_words").alias("n_words"),
        _runs_length(F.col(f"{hit}.starts"), F.col(f"{hit}.ends")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(f"{hit}.starts") > 0).alias("contaminated"),
    )

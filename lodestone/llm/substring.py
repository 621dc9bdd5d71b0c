"""Substring deduplication with fixed-block anchors.

A text is its sequence of words. Of every text the non-overlapping blocks of BLOCK words are the index; every
rolling window of BLOCK words probes it. A repeated WINDOW of 2 x BLOCK words holds a whole block, so it
always leaves a hit on both sides. Around hits, windows of WINDOW words are compared by a 96-bit digest, and
neighbouring repeated windows grow into maximal exact repeats. Of each distinct window the occurrence of the
smallest (id, position) stays; words covered by a window that also starts earlier go.

Texts equal to an earlier one are settled by a digest of the whole text and don't take part. Exchanges are
those of `exchange`: each chunk sends a distinct hash once. Null, empty and short texts keep all their words;
rows that repeat an id and text get the same result; null ids count as one id after all others. Different
texts of one id are rows of their own, in the order of their texts. Ids that aren't whole numbers are taken in
their own order. An empty table gives none; other columns aren't read.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import exchange as X
from lodestone.llm.common import Staged, arrow_batches, named, text_or_empty, whole_ids
from lodestone.llm.grams import ODD, WordHash, grams, hashes

WINDOW, BLOCK = 20, 10
#: Words of a chunk.
CHUNK_WORDS = 500_000
SECOND = np.uint64(0xD6E8FEB86659FD93)
#: `nth` tells the texts of one id apart: see _rows.
FOUND = np.dtype([("h", "<u8"), ("g", "<u4"), ("id", "<i8"), ("nth", "<u4"), ("pos", "<u4")])
RUN = np.dtype([("id", "<i8"), ("nth", "<u4"), ("start", "<u4"), ("end", "<u4")])

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def digest_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _basics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, n_words, kept_sha256 if nothing is removed) in one narrow pass."""

    @F.pandas_udf("digest binary, n_words long, kept_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found = words(t)
                rows.append((digest_of(t), len(found), hashlib.sha256(" ".join(found).encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["digest", "n_words", "kept_sha256"])

    return docs.select(X.known_id(key).alias("id"), run(text_or_empty(text)).alias("b")).select("id", "b.*")


def _rows(left: pd.DataFrame, skip: dict[int, set[bytes]], digest=digest_of):
    """(id, nth, text) of the texts of a chunk, each row once; nth counts the texts of an id in their order."""
    pairs = {(int(i), t) for i, t in zip(left["id"], left["text"]) if t is not None and (int(i) not in skip or digest(t) not in skip[int(i)])}
    last, nth = None, 0
    for doc, text in sorted(pairs):
        last, nth = doc, nth + 1 if doc == last else 0
        yield doc, nth, text


def _split(right: pd.DataFrame) -> tuple[dict[int, set[bytes]], list[bytes]]:
    """The digests of copies by id, and the packed answers for this chunk."""
    skip: dict[int, set[bytes]] = {}
    if not len(right):
        return skip, []
    copies = right["data"].isna()
    for doc, digest in zip(right.loc[copies, "id"].tolist(), right.loc[copies, "digest"]):
        skip.setdefault(int(doc), set()).add(bytes(digest))
    return skip, list(right.loc[~copies, "data"])


def _probe(width: int, n: int):
    """Chunk -> buckets: every rolling block hash once, flagged where it is an indexed block or occurs again."""
    drop = np.uint64(66 - 8 * width)  # 64 - (8 * width - 2) bits

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        skip, _ = _split(right)
        known, parts, flags = WordHash(), [], []
        for _, _, text in _rows(left, skip):
            found = words(text)
            if len(found) >= WINDOW:
                g = grams(hashes(known, found), BLOCK)
                parts.append(g)
                flags.append(np.arange(len(g)) % BLOCK == 0)
        if not parts:
            return pd.DataFrame({"bucket": [], "chunk": [], "data": []})
        h, block = np.concatenate(parts), np.concatenate(flags)
        order = np.argsort(h, kind="stable")
        h, block = h[order] >> drop, block[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        times = np.diff(np.append(first, len(h)))
        anchored = np.maximum.reduceat(block, first)
        values = (h[first] << np.uint64(2)) | anchored.astype(np.uint64) | ((times > 1).astype(np.uint64) << np.uint64(1))
        rows = [(b, key[0], X.pack(values[s:e], width)) for b, s, e in X.by_bucket(h[first] << drop, n)]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "data"])

    return run


def _windows(width: int, n: int):
    """Chunk -> buckets: around hits, the first occurrence of every window here; repeats within the chunk as runs."""
    drop = np.uint64(66 - 8 * width)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        skip, answers = _split(right)
        empty = pd.DataFrame({"bucket": [], "chunk": [], "data": []})
        if not answers:
            return empty
        live = np.sort(np.concatenate([X.unpack(a, width) for a in answers]) >> np.uint64(2))
        known, parts = WordHash(), []
        for doc, nth, text in _rows(left, skip):
            found = words(text)
            if len(found) < WINDOW:
                continue
            h = hashes(known, found)
            g = grams(h, BLOCK) >> drop
            k = np.searchsorted(live, g)
            k[k == len(live)] = 0
            hit = np.concatenate([[0], np.cumsum(live[k] == g)])
            at = np.flatnonzero(hit[WINDOW - BLOCK + 1 :] > hit[: -(WINDOW - BLOCK + 1)])
            if len(at):
                out = np.empty(len(at), FOUND)
                out["h"], out["g"] = grams(h, WINDOW)[at], (grams(h, WINDOW, SECOND)[at] >> np.uint64(32)).astype(np.uint32)
                out["id"], out["nth"], out["pos"] = doc, nth, at
                parts.append(out)
        if not parts:
            return empty
        found = np.concatenate(parts)
        found = found[np.lexsort((found["pos"], found["nth"], found["id"], found["g"], found["h"]))]
        first = _firsts(found)
        again = found[~first]
        rows = [(-1, key[0], _packed_runs(again, WINDOW))] if len(again) else []
        once = found[first]
        rows += [(b, key[0], once[s:e].tobytes()) for b, s, e in X.by_bucket(once["h"], n)]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "data"])

    return run


def _firsts(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.empty(0, bool)
    return np.append(True, (found["h"][1:] != found["h"][:-1]) | (found["g"][1:] != found["g"][:-1]))


def _packed_runs(found: np.ndarray, span: int) -> bytes:
    """(id, nth, start, end) of the maximal runs of windows, by id and nth."""
    found = found[np.lexsort((found["pos"], found["nth"], found["id"]))]
    pos, doc, nth = found["pos"].astype(np.int64), found["id"], found["nth"]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (pos[1:] > pos[:-1] + span)) + 1
    first, last = np.append(0, cut), np.append(cut, len(found)) - 1
    out = np.empty(len(first), RUN)
    out["id"], out["nth"], out["start"], out["end"] = doc[first], nth[first], pos[first], pos[last] + span
    return out.tobytes()


def _later(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bucket -> chunks: of each window, all but the first occurrence."""
    parts = [np.frombuffer(d, FOUND) for d in pdf["data"]]
    found = np.concatenate(parts)
    source = np.repeat(np.asarray(pdf["chunk"]), [len(p) for p in parts])
    order = np.lexsort((found["pos"], found["nth"], found["id"], found["g"], found["h"]))
    again = order[~_firsts(found[order])]
    rows = [(int(c), _packed_runs(found[again[source[again] == c]], WINDOW)) for c in np.unique(source[again])]
    return pd.DataFrame(rows, columns=["chunk", "data"])


def covered(parts: list[bytes]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The union of packed runs by id and nth."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if parts:
        r = np.frombuffer(b"".join(parts), RUN)
        r = r[np.lexsort((r["start"], r["nth"], r["id"]))]
        for doc, nth, s, e in zip(r["id"].tolist(), r["nth"].tolist(), r["start"].tolist(), r["end"].tolist()):
            own = out.setdefault((doc, nth), [])
            if own and s <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], e))
            else:
                own.append((s, e))
    return out


def _cut(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The texts of a chunk without their repeated runs."""
    skip, answers = _split(right)
    spans, rows = covered(answers), []
    for doc, nth, text in _rows(left, skip) if spans else []:
        if (doc, nth) in spans:
            found = words(text)
            kept, at = [], 0
            for s, e in spans[doc, nth]:
                kept += found[at:s]
                at = e
            kept += found[at:]
            rows.append((doc, digest_of(text), len(found) - len(kept), " ".join(kept), [{"start": s, "end": e} for s, e in spans[doc, nth]]))
    return pd.DataFrame(rows, columns=["id", "digest", "n_removed", "kept", "runs"])


CUT = "id long, digest binary, n_removed long, kept string, runs array<struct<start:long,end:long>>"


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(basics, copies, cut): every row's digest and words; ids of copies of an earlier text; texts that lose some words.

    cut: id, digest, n_removed, kept (text), runs (maximal repeated word runs that were removed).
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    basics = Staged(_basics(docs, key, text), "basics").df
    total = basics.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n, width = max(1, -(-total // CHUNK_WORDS)), X.hash_bytes(total)
    copies = Staged(X.later_copies(basics.where(F.col("n_words") >= WINDOW)), "copies").df
    chunks = X.chunked(docs, key, text, n).groupBy("chunk")
    skip = X.keyed_by_chunk(copies, n).select("chunk", "id", "digest", F.lit(None).cast("binary").alias("data"))
    answers = lambda df: df.select("chunk", F.lit(0).cast("long").alias("id"), F.lit(None).cast("binary").alias("digest"), "data").unionByName(skip).groupBy("chunk")

    message = "bucket int, chunk int, data binary"
    sent = chunks.cogroup(skip.groupBy("chunk")).applyInPandas(_probe(width, n), message)
    live = Staged(sent.groupBy("bucket").applyInPandas(X.live_hashes(width), "chunk int, data binary"), "live")
    windows = Staged(chunks.cogroup(answers(live.df)).applyInPandas(_windows(width, n), message), "windows")
    live.drop()
    later = Staged(windows.df.where("bucket >= 0").groupBy("bucket").applyInPandas(_later, "chunk int, data binary"), "later")
    local = Staged(windows.df.where("bucket < 0").select("chunk", "data"), "local")
    windows.drop()
    cut = chunks.cogroup(answers(later.df.unionByName(local.df))).applyInPandas(_cut, CUT)
    return basics, copies, cut


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs, names = whole_ids(docs)
    basics, copies, cut = deduplicated(docs)
    gone = copies.select("id", "digest", F.lit(True).alias("copy"))
    some = cut.select("id", "digest", "n_removed", F.sha2("kept", 256).alias("sha"))
    rest = basics.join(gone, ["id", "digest"], "left").join(some, ["id", "digest"], "left")
    found = rest.select(
        F.when(F.col("id") != X.NULL_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"),
    )
    return named(found, names, "doc_id")

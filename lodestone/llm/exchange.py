"""Bounded two-hop exchange between chunks of documents and buckets of hashes.

Documents are dealt to chunks of about equal size by the hash of their id. A chunk sends each distinct hash
it holds at most once, packed by bucket, so one hash (a passage that a third of all texts share) reaches its
bucket once per chunk, not once per text. A bucket answers each chunk with packed bytes again. Both sides of
every hop are bounded: a chunk by its share of the text, a bucket by its share of the distinct hashes.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that are null take part under this one, after all others.
NULL_ID = 2**63 - 1


def known_id(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))


def chunked(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(chunk, id, text)"""
    rows = docs.select(known_id(key).alias("id"), F.col(text).alias("text"))
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("chunk"), "id", "text")


def keyed_by_chunk(ids: DataFrame, n: int) -> DataFrame:
    return ids.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("chunk"), "id", "digest")


def later_copies(basics: DataFrame) -> DataFrame:
    """(id, digest) of every text that an earlier id has too, each once.

    Pairs are made distinct before the join, so nothing above it needs its partitioning and Spark can split a digest
    that very many rows share.
    """
    first = basics.groupBy("digest").agg(F.min("id").alias("first"))
    return basics.select("id", "digest").distinct().join(first, "digest").where("id > first").select("id", "digest")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, by its highest 32 bits: ascending hashes have ascending buckets."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def by_bucket(h: np.ndarray, n: int):
    """(bucket, start, end) of each bucket present, for hashes in ascending order."""
    b = bucket_of(h, n)
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, np.int64)
    for s, e in zip(starts.tolist(), np.append(starts[1:], len(b)).tolist()):
        yield int(b[s]), s, e


def hash_bytes(total: int) -> int:
    """Bytes of a packed hash with two flag bits: 2**10 times as many values as hashes, at least."""
    return min(8, max(5, math.ceil((math.log2(max(2, total)) + 12) / 8)))


def pack(values: np.ndarray, width: int) -> bytes:
    """Ascending numbers of at most `width` bytes as gaps of few bytes; wider gaps follow in full."""
    values = values.astype(np.uint64)
    gaps = np.diff(values, prepend=np.uint64(0))
    small = min(range(2, width + 1), key=lambda w: w * len(gaps) + (width * int((gaps >= (1 << (8 * w)) - 1).sum()) if w < width else 0))
    full = np.uint64((1 << (8 * small)) - 1)
    wide = gaps >= full if small < width else np.zeros(len(gaps), bool)
    return bytes([small]) + len(gaps).to_bytes(8, "little") + _narrow(np.where(wide, full, gaps), small) + _narrow(gaps[wide], width)


def unpack(data: bytes, width: int) -> np.ndarray:
    small, n = data[0], int.from_bytes(data[1:9], "little")
    gaps = _widen(data[9 : 9 + small * n], small)
    if small < width:
        gaps[gaps == np.uint64((1 << (8 * small)) - 1)] = _widen(data[9 + small * n :], width)
    return np.cumsum(gaps, dtype=np.uint64)


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8")[:, None].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def live_hashes(width: int):
    """For applyInPandas over buckets: which hashes occur at least twice (and are anchored, where flag 1 asks for it).

    Values are hash * 4 + flags: 1 anchored, 2 more than once in its chunk. The answer to a chunk holds hash * 4,
    plus 1 if more than HOT chunks hold it.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d, width) for d in pdf["data"]]
        values = np.concatenate(parts)
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(values >> np.uint64(2), kind="stable")
        values, source = values[order], source[order]
        h = values >> np.uint64(2)
        fresh = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(fresh) - 1
        count = np.bincount(group)
        anchored = np.bincount(group, weights=(values & np.uint64(1)).astype(float)) > 0
        several = np.bincount(group, weights=((values >> np.uint64(1)) & np.uint64(1)).astype(float)) > 0
        live = (((count > 1) | several) & anchored)[group]
        answer = (h[live] << np.uint64(2)) | (count[group][live] > HOT).astype(np.uint64)
        source = source[live]
        order = np.argsort(source, kind="stable")
        answer, source = answer[order], source[order]
        cuts = np.searchsorted(source, np.arange(len(parts) + 1))
        rows = [(int(c), pack(answer[a:b], width)) for c, a, b in zip(pdf["chunk"], cuts[:-1], cuts[1:]) if b > a]
        return pd.DataFrame(rows, columns=["chunk", "data"])

    return run


#: A hash in more chunks than this is hot: what depends on it is spread further.
HOT = 256


def runs(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal (start, end) runs covered by spans of one length at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + span) + 1
    return [(int(p[0]), int(p[-1]) + span) for p in np.split(starts, cut)]

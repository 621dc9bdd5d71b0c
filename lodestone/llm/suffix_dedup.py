"""Suffix-array deduplication of byte strings.

A text is its UTF-8 bytes. Every SPAN-byte string that also starts earlier (smaller id, or same text and
earlier start) is removed, wherever it overlaps; repeats are judged on the input.

No machine holds a suffix array of the corpus, and most of it repeats nowhere. So texts are sampled at
content-defined anchors (the smallest GRAM-byte hash of each SPAN-byte string; equal strings have equal
anchors), anchors seen once are dropped, and what's left are short segments: an anchor with all SPAN-byte
strings that belong to it. The distinct segments of an anchor are concatenated to pieces of bounded length, a
suffix array of each is built by linear grouping construction (`gsaca`), and neighbours in suffix order that
agree on SPAN bytes are the repeats; of each class the occurrence of the smallest (id, start) stays. Where an
anchor has several pieces, their sorted distinct strings are merged, in shares of bounded size, and compared
byte by byte: a repeat that spans pieces is found there.

An anchor in more than `exchange.HOT` chunks doesn't gather in one task: its pieces are those of each chunk,
and the strings that the chunk's suffix arrays leave are merged in the buckets of their own hashes.

Texts equal to an earlier one are settled by a digest of the whole text. Null and empty texts have no bytes;
texts shorter than SPAN lose none; rows that repeat an id and text get the same result; null ids count as one id
after all others, and different texts of one id are rows of their own, in the order of their texts. Ids that aren't whole numbers are taken in
their own order. An empty table gives none; other columns aren't read.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import exchange as X
from lodestone.llm.common import Staged, arrow_batches, named, whole_ids
from lodestone.llm.grams import mixed
from lodestone.llm.gsaca import suffix_arrays
from lodestone.llm.substring import RUN, _rows, _split, covered

SPAN, GRAM = 100, 40
#: Hashes of which the smallest is an anchor: the GRAM-byte strings of a SPAN-byte string.
CHOICE = SPAN - GRAM + 1
CHUNK_BYTES = 4_000_000
#: Bytes of segments that are concatenated for one suffix array, about; symbols of a batch of them.
PIECE, BATCH = 2_000, 500_000
#: Strings that are merged at once, about.
SHARE = 200_000

_RNG = np.random.default_rng(17)
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = int(_RNG.integers(0, 2**62)) * 4 + 3
SEGMENT = np.dtype([("h", "<u8"), ("id", "<i8"), ("nth", "<u4"), ("pos", "<u4"), ("size", "<u4")])


def power(n: int) -> np.uint64:
    return np.uint64(pow(STEP, n, 2**64))


def rolling(data: np.ndarray) -> dict[int, np.ndarray]:
    """Polynomial hashes of all strings of 8 and of 32 bytes, by doubling."""
    out, h, n = {}, BYTE[data], 1
    while n < 32:
        h = h[:-n] * power(n) + h[n:]
        n *= 2
        out[n] = h
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings."""
    h = rolling(data)
    n = len(data) - GRAM + 1
    return mixed(h[32][:n] * power(8) + h[8][32 : 32 + n])


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours."""
    size, low = 1, x
    while size * 2 <= n:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(x) - n + 1], low[n - size : n - size + len(x) - n + 1]) if size < n else low


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start, last start) of each anchor and the SPAN-byte strings that belong to it.

    A string belongs to the leftmost position of the smallest hash within it.
    """
    g = gram_hashes(data)
    rank = (g >> np.uint64(32)).astype(np.uint32)
    low = sliding_least(rank, CHOICE)
    # The first position of the smallest rank of each string: those of equal rank are told apart by jumping.
    chosen = np.flatnonzero(rank == _sliding_most(low, len(rank)))
    starts = np.arange(len(low))
    at = np.searchsorted(chosen, starts)
    own = chosen[at]
    wrong = np.flatnonzero(rank[own] != low)
    while len(wrong):
        at[wrong] += 1
        own[wrong] = chosen[at[wrong]]
        wrong = wrong[rank[own[wrong]] != low[wrong]]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    last = np.append(first[1:], len(own)) - 1
    return spread(g[own[first]]), own[first], starts[first], starts[last]


def spread(h: np.ndarray) -> np.ndarray:
    """Chosen hashes are the smallest of many; this deals them evenly to buckets again."""
    return mixed((h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD))


def _sliding_most(low: np.ndarray, n: int) -> np.ndarray:
    """For each position, the largest minimum among the strings that hold it: it equals the rank where the position is a minimum."""
    pad = np.zeros(CHOICE - 1, low.dtype)
    return ~sliding_least(~np.concatenate([pad, low, pad]), CHOICE)[:n]


def _basics(docs: DataFrame, key: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(X.known_id(key).alias("id"), F.unhex(F.substring(F.sha2(data, 256), 1, 32)).alias("digest"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("kept_sha256"))


def _bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _digest_of(text: str) -> bytes:
    return hashlib.sha256(_bytes_of(text)).digest()[:16]


def _probe(width: int, n: int):
    """Chunk -> buckets: the hash of every anchor once, flagged where it occurs again."""
    drop = np.uint64(66 - 8 * width)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        skip, _ = _split(right)
        parts = []
        for _, _, text in _rows(left, skip, _digest_of):
            data = np.frombuffer(_bytes_of(text), np.uint8)
            if len(data) >= SPAN:
                parts.append(anchors(data)[0])
        if not parts:
            return pd.DataFrame({"bucket": [], "chunk": [], "data": []})
        h = np.sort(np.concatenate(parts)) >> drop
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        times = np.diff(np.append(first, len(h)))
        values = (h[first] << np.uint64(2)) | np.uint64(1) | ((times > 1).astype(np.uint64) << np.uint64(1))
        return pd.DataFrame([(b, key[0], X.pack(values[s:e], width)) for b, s, e in X.by_bucket(h[first] << drop, n)], columns=["bucket", "chunk", "data"])

    return run


def packed_runs(rows: list[tuple[int, int, int, int]]) -> bytes:
    return np.array(rows, RUN).tobytes()


def _segments(width: int, n: int):
    """Chunk -> buckets: the distinct segments of live anchors; those that occur again in the chunk as runs."""
    drop = np.uint64(66 - 8 * width)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        skip, answers = _split(right)
        empty = pd.DataFrame({"bucket": [], "chunk": [], "data": []})
        if not answers:
            return empty
        live = np.sort(np.concatenate([X.unpack(a, width) for a in answers]))
        hot, live = (live & np.uint64(1)).astype(bool), live >> np.uint64(2)
        seen: set[bytes] = set()
        again: list[tuple[int, int, int, int]] = []
        found: list[tuple[int, int, int, int, bytes]] = []
        wide: dict[int, list[tuple[int, int, int, int, bytes]]] = {}
        for doc, nth, text in _rows(left, skip, _digest_of):
            raw = _bytes_of(text)
            if len(raw) < SPAN:
                continue
            h, _, lo, hi = anchors(np.frombuffer(raw, np.uint8))
            short = h >> drop
            k = np.searchsorted(live, short)
            k[k == len(live)] = 0
            at = np.flatnonzero(live[k] == short)
            for x, a, b, spread_out in zip(h[at].tolist(), lo[at].tolist(), hi[at].tolist(), hot[k[at]].tolist()):
                piece = raw[a : b + SPAN]
                if piece in seen:
                    again.append((doc, nth, a, a + len(piece)))
                    continue
                seen.add(piece)
                if spread_out:
                    wide.setdefault(x, []).append((doc, nth, a, key[0], piece))
                else:
                    found.append((x, doc, nth, a, piece))
        for groups in batches(list(wide.values())):
            kept, gone = settled(groups)
            for _, some in runs_by_chunk(gone):
                again += some
            for group, at in zip(groups, kept):
                for (doc, nth, pos, _), string in zip(group.where(at).tolist(), group.strings(at)):
                    string = string.tobytes()
                    found.append((int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little"), doc, nth, pos, string))
        rows = [(-1, key[0], packed_runs(again))] if again else []
        if found:
            found.sort(key=lambda x: x[0])
            h, doc, nth, pos = (np.array([x[k] for x in found], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.uint32), (3, np.uint32)))
            meta = np.empty(len(found), SEGMENT)
            meta["h"], meta["id"], meta["nth"], meta["pos"], meta["size"] = h, doc, nth, pos, [len(x[4]) for x in found]
            for b, s, e in X.by_bucket(h, n):
                rows.append((b, key[0], np.int64(e - s).tobytes() + meta[s:e].tobytes() + b"".join(x[4] for x in found[s:e])))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "data"])

    return run


def pieces_of(segments: list[bytes]) -> list[range]:
    """The segments of an anchor in runs of about PIECE bytes."""
    out, start, size = [], 0, 0
    for k, x in enumerate(segments):
        if size and size + len(x) > PIECE:
            out.append(range(start, k))
            start, size = k, 0
        size += len(x) + 1
    out.append(range(start, len(segments)))
    return out


def sorted_strings(strings: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each list of distinct segments: (segment, start, class) of every SPAN-byte string, in suffix order.

    The segments, with separators, are one string; its suffix array puts equal strings side by side: they're a class.
    """
    lines = []
    for segments in strings:
        line = np.full(sum(map(len, segments)) + len(segments), 1, np.uint16)  # 1 separates; bytes are 2 and up
        at = 0
        for p in segments:
            line[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 2
            at += len(p) + 1
        lines.append(line)
    out = []
    for segments, line, order in zip(strings, lines, suffix_arrays(lines)):
        sizes = np.fromiter((len(p) + 1 for p in segments), np.int64, len(segments))
        ends = np.cumsum(sizes) - 1
        segment = np.searchsorted(ends, order)
        whole = order + SPAN <= ends[segment]
        order, segment = order[whole], segment[whole]
        windows = np.lib.stride_tricks.sliding_window_view(line, SPAN)[order]
        fresh = np.append(True, (windows[1:] != windows[:-1]).any(axis=1))
        out.append((segment, order - (ends[segment] + 1 - sizes[segment]), np.cumsum(fresh)))
    return out


def firsts(cls: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each class, the others), as indices; where has a row of (id, nth, start, chunk) for each string."""
    order = np.lexsort((where[:, 2], where[:, 1], where[:, 0], cls))
    fresh = np.append(True, cls[order][1:] != cls[order][:-1])
    return order[fresh], order[~fresh]


@dataclass
class Group:
    """The distinct segments of an anchor, each with its (id, nth, start, chunk)."""

    segments: list[bytes]
    homes: np.ndarray

    def __post_init__(self):
        self.data = np.frombuffer(b"".join(self.segments), np.uint8)
        sizes = np.fromiter(map(len, self.segments), np.int64, len(self.segments))
        self.begin = np.cumsum(sizes) - sizes

    def where(self, at: np.ndarray) -> np.ndarray:
        """The (id, nth, start, chunk) of strings at places of the joined segments."""
        k = np.searchsorted(self.begin, at, side="right") - 1
        out = self.homes[k]
        out[:, 2] += at - self.begin[k]
        return out

    def strings(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, SPAN)[at]

    def merged(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of first strings, rows of the others): the pieces' sorted strings meet, in shares dealt by content."""
        shares = -(-len(at) // SHARE)
        deal = span_hashes(self.data)[at] % np.uint64(shares) if shares > 1 else np.zeros(len(at), np.uint64)
        stay, gone = [], []
        for k in range(shares):
            own = at[deal == k]
            if not len(own):
                continue
            lines = np.ascontiguousarray(self.strings(own))
            order = np.argsort(lines.view(f"S{SPAN}").ravel(), kind="stable")
            lines, own = lines[order], own[order]
            cls = np.cumsum(np.append(True, (lines[1:] != lines[:-1]).any(axis=1)))
            where = self.where(own)
            first, rest = firsts(cls, where)
            stay.append(own[first])
            gone.append(where[rest])
        return np.concatenate(stay), np.concatenate(gone)


def span_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every SPAN-byte string, to deal them by."""
    h, n = rolling(data), len(data) - SPAN + 1
    out = np.zeros(n, np.uint64)
    for k in range(0, SPAN - 31, 32):
        out = out * power(32) + h[32][k : k + n]
    return mixed(out * power(4) + h[4][SPAN - 4 : SPAN - 4 + n])


def settled(groups: list[Group]) -> tuple[list[np.ndarray], np.ndarray]:
    """(kept, gone): for each group the places of the first occurrence of every distinct string; rows of (id, nth, start, chunk) of all others."""
    runs, owner = [], []
    for g, group in enumerate(groups):
        for r in pieces_of(group.segments):
            runs.append([group.segments[k] for k in r])
            owner.append((g, r.start))
    held: list[list[np.ndarray]] = [[] for _ in groups]
    gone = [np.empty((0, 4), np.int64)]
    for (g, start), (segment, offset, cls) in zip(owner, sorted_strings(runs)):
        if len(segment):
            at = groups[g].begin[segment + start] + offset
            where = groups[g].where(at)
            stay, go = firsts(cls, where)
            gone.append(where[go])
            held[g].append(at[stay])
    kept = []
    for group, parts in zip(groups, held):
        at = np.concatenate(parts) if parts else np.empty(0, np.int64)
        if len(parts) > 1:
            at, more = group.merged(at)
            gone.append(more)
        kept.append(at)
    return kept, np.concatenate(gone)


def runs_by_chunk(where: np.ndarray):
    """(chunk, runs) of rows of (id, nth, start, chunk): strings of one text that overlap or touch are one run."""
    where = where[np.lexsort((where[:, 2], where[:, 1], where[:, 0], where[:, 3]))]
    if not len(where):
        return
    doc, nth, pos, chunk = where.T
    fresh = np.append(True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (pos[1:] > pos[:-1] + SPAN))
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(where)) - 1
    runs = list(zip(doc[head].tolist(), nth[head].tolist(), pos[head].tolist(), (pos[tail] + SPAN).tolist()))
    cut = np.flatnonzero(np.append(True, chunk[head][1:] != chunk[head][:-1])).tolist()
    for a, b in zip(cut, [*cut[1:], len(head)]):
        yield int(chunk[head[a]]), runs[a:b]


def batches(anchored) -> Iterator[list[Group]]:
    """Groups in batches of about BATCH bytes, those of like size together. anchored: lists of (id, nth, start, chunk, segment)."""
    batch, size = [], 0
    for own in sorted(anchored, key=lambda g: min(PIECE, sum(len(x[4]) for x in g))):
        batch.append(Group([x[4] for x in own], np.array([x[:4] for x in own], np.int64)))
        size += len(batch[-1].data)
        if size >= BATCH:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _later(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bucket -> chunks: the SPAN-byte strings that also start earlier, as runs."""
    first: dict[bytes, tuple[int, int, int, int, int]] = {}  # segment -> its first (id, nth, start, chunk, anchor)
    gone: dict[int, list[tuple[int, int, int, int]]] = {}
    for chunk, data in zip(pdf["chunk"].tolist(), pdf["data"]):
        n = int(np.frombuffer(data, np.int64, 1)[0])
        meta = np.frombuffer(data, SEGMENT, n, 8)
        at = 8 + n * SEGMENT.itemsize
        for h, doc, nth, pos, size in zip(*(meta[c].tolist() for c in ("h", "id", "nth", "pos", "size"))):
            piece = data[at : at + size]
            at += size
            now, old = (doc, nth, pos, chunk, h), first.get(piece)
            if old is not None:
                now, old = min(now, old), max(now, old)
                gone.setdefault(old[3], []).append((old[0], old[1], old[2], old[2] + size))
            first[piece] = now
    by_anchor: dict[int, list[tuple[int, int, int, int, bytes]]] = {}
    for piece, (doc, nth, pos, chunk, h) in first.items():
        by_anchor.setdefault(h, []).append((doc, nth, pos, chunk, piece))
    del first
    # Strings of one anchor differ within a segment: where it has one segment, nothing more can repeat.
    for groups in batches([g for g in by_anchor.values() if len(g) > 1]):
        for chunk, some in runs_by_chunk(settled(groups)[1]):
            gone.setdefault(chunk, []).extend(some)
    return pd.DataFrame([(c, packed_runs(joined(r))) for c, r in gone.items()], columns=["chunk", "data"])


def joined(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping runs of one text as one."""
    out: list[tuple[int, int, int, int]] = []
    for doc, nth, s, e in sorted(set(runs)):
        if out and out[-1][:2] == (doc, nth) and s <= out[-1][3]:
            out[-1] = (doc, nth, out[-1][2], max(e, out[-1][3]))
        else:
            out.append((doc, nth, s, e))
    return out


def _cut(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The texts of a chunk without their repeated runs."""
    skip, answers = _split(right)
    spans, rows = covered(answers), []
    for doc, nth, text in _rows(left, skip, _digest_of) if spans else []:
        if (doc, nth) in spans:
            raw, kept, at = _bytes_of(text), [], 0
            for s, e in spans[doc, nth]:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            left_over = b"".join(kept)
            rows.append((doc, _digest_of(text), len(raw) - len(left_over), left_over, [{"start": s, "end": e} for s, e in spans[doc, nth]]))
    return pd.DataFrame(rows, columns=["id", "digest", "n_removed", "kept", "runs"])


CUT = "id long, digest binary, n_removed long, kept binary, runs array<struct<start:long,end:long>>"


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(basics, copies, cut): every row's digest and bytes; ids of copies of an earlier text; texts that lose some bytes.

    cut: id, digest, n_removed, kept (bytes), runs (maximal removed byte runs).
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    basics = Staged(_basics(docs, key, text), "basics").df
    total = basics.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n, width = max(1, -(-total // CHUNK_BYTES)), X.hash_bytes(max(1, total // 16))
    copies = Staged(X.later_copies(basics.where(F.col("n_bytes") >= SPAN)), "copies").df
    chunks = X.chunked(docs, key, text, n).groupBy("chunk")
    skip = X.keyed_by_chunk(copies, n).select("chunk", "id", "digest", F.lit(None).cast("binary").alias("data"))
    answers = lambda df: df.select("chunk", F.lit(0).cast("long").alias("id"), F.lit(None).cast("binary").alias("digest"), "data").unionByName(skip).groupBy("chunk")

    message = "bucket int, chunk int, data binary"
    sent = chunks.cogroup(skip.groupBy("chunk")).applyInPandas(_probe(width, n), message)
    live = Staged(sent.groupBy("bucket").applyInPandas(X.live_hashes(width), "chunk int, data binary"), "live")
    segments = Staged(chunks.cogroup(answers(live.df)).applyInPandas(_segments(width, n), message), "segments")
    live.drop()
    later = Staged(segments.df.where("bucket >= 0").groupBy("bucket").applyInPandas(_later, "chunk int, data binary"), "later")
    local = Staged(segments.df.where("bucket < 0").select("chunk", "data"), "local")
    segments.drop()
    cut = chunks.cogroup(answers(later.df.unionByName(local.df))).applyInPandas(_cut, CUT)
    return basics, copies, cut


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, names = whole_ids(docs)
    basics, copies, cut = deduplicated(docs)
    gone = copies.select("id", "digest", F.lit(True).alias("copy"))
    some = cut.select("id", "digest", "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    rest = basics.join(gone, ["id", "digest"], "left").join(some, ["id", "digest"], "left")
    none = F.lit(0).cast("long")
    found = rest.select(
        F.when(F.col("id") != X.NULL_ID, F.col("id")).alias("doc_id"),
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"),
    )
    return named(found, names, "doc_id")

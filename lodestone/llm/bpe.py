"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never be merged
across, so a cut between them is certain. A text is cut at its special tokens, at the pre-tokenizer's
boundaries and at every such byte pair; each fragment is encoded alone and the ids are concatenated.
The result equals encoding the whole text.

The pre-tokenizer always cuts before a space that a non-space follows, so a text is first split there, which
needs no pattern. Such pieces repeat a lot and are kept in a bounded cache; those of a batch of texts that
aren't known are encoded together: one table look-up over their concatenated bytes finds the certain cuts, and
all fragments take their lowest-ranked merge in the same step, as arrays.

Nulls are empty texts and have no tokens; ties between equal pairs go to the leftmost; repeated rows get equal
results, row by row; an empty table gives none. Long texts are worked off in slices, so what a task holds is
bounded by an Arrow batch and a slice.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_batches, text_or_empty, with_struct

#: Pieces of more characters aren't kept; the cache is emptied when it holds so many pieces.
CACHE_CHARS, CACHE_PIECES = 48, 400_000
#: Fragments of at most so many bytes are merged together with others, longer ones alone with a heap.
SHARED_BYTES = 32
#: Characters of texts that are split at once.
SLICE_CHARS = 1 << 20
NEVER = 1 << 30

#: Fixed value: the pre-tokenizer's pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else the next free code point from 256."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


#: Where the pre-tokenizer always cuts: before a space that no space follows. A space of any other use is ODD.
CUT, ODD = re.compile(r" (?=\S)"), re.compile(r" (?=\s|\Z)")


class Codec:
    """Encodes and decodes whole texts with a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            left, right = raw(left), raw(right)
            self.rank[vocab[left], vocab[right]] = (n, vocab[left + right])
        self.single = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        #: joined[a * 256 + b]: some token holds byte b right after byte a. Other pairs are forced boundaries.
        self.joined = np.zeros(65536, bool)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                self.joined[a * 256 + b] = True
        self.base = max(self.bytes_of) + 1
        pairs = sorted((a * self.base + b, n, new) for (a, b), (n, new) in self.rank.items())
        self.keys, self.ranks = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.zeros(len(pairs), np.int64)
        self.merged[self.ranks] = [p[2] for p in pairs]
        self.words = regex.compile(SPLIT)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a forced boundary lies before each byte."""
        out = np.ones(len(data), bool)
        out[1:] = ~self.joined[data[:-1].astype(np.int64) * 256 + data[1:]]
        return out

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER for those that don't merge."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NEVER) if len(self.keys) else np.full(len(key), NEVER)

    def merge(self, fragment: bytes) -> list[int]:
        """The lowest-ranked pair first, the leftmost among equals, until no pair is left."""
        ids, rank = self.single[np.frombuffer(fragment, np.uint8)].tolist(), self.rank
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, found[1], ids[k], ids[k + 1]) for k in range(n - 1) if (found := rank.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, new, left, right = heapq.heappop(heap)
            m = after[k]
            if ids[k] != left or m >= n or ids[m] != right:
                continue
            ids[k], ids[m] = new, -1
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n and (found := rank.get((ids[a], ids[after[a]]))):
                    heapq.heappush(heap, (found[0], a, found[1], ids[a], ids[after[a]]))
        return [i for i in ids if i >= 0]

    def merge_all(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their first bytes), in order, of many fragments: data has their bytes, start marks where each begins.

        In a step every fragment that isn't done takes its lowest-ranked pair, the leftmost among equals.
        """
        ids, place = self.single[data], np.arange(len(data))
        rank = np.full(len(data), NEVER)
        inner = np.flatnonzero(~start[1:])
        rank[inner] = self.ranked(ids[inner], ids[inner + 1])
        done_ids, done_place = [], []
        while len(ids):
            head = np.flatnonzero(start)
            size = np.diff(np.append(head, len(ids)))
            low = np.minimum.reduceat(rank, head)
            over = np.repeat(low == NEVER, size)
            if over.any():
                done_ids.append(ids[over])
                done_place.append(place[over])
                ids, place, rank, start = ids[~over], place[~over], rank[~over], start[~over]
                size, low = size[low != NEVER], low[low != NEVER]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            own = np.repeat(np.arange(len(size)), size)[at]
            at = at[np.append(True, own[1:] != own[:-1])]
            ids[at] = self.merged[low]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at] = NEVER
            ids, place, rank, start = ids[keep], place[keep], rank[keep], start[keep]
            at = at - np.arange(len(at))
            ends = np.append(start[1:], True)
            more = np.concatenate([at[~ends[at]], at[~start[at]] - 1])
            rank[more] = self.ranked(ids[more], ids[more + 1])
        if not done_ids:
            return ids, place
        ids, place = np.concatenate(done_ids), np.concatenate(done_place)
        order = np.argsort(place, kind="stable")
        return ids[order], place[order]

    def encode_words(self, found: list[str]) -> list[list[int]]:
        """The ids of each of many pre-tokens, none of them empty."""
        rows = [w.encode("utf-8") for w in found]
        data = np.frombuffer(b"".join(rows), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        begin = ends - np.fromiter(map(len, rows), np.int64, len(rows))
        start = self.cuts(data)
        start[begin] = True
        head = np.flatnonzero(start)
        size = np.diff(np.append(head, len(data)))
        alone = np.flatnonzero(size > SHARED_BYTES)
        if len(alone):
            long_ = np.repeat(size > SHARED_BYTES, size)
            where = np.flatnonzero(~long_)
            ids, place = self.merge_all(data[where], start[where])
            place = where[place]
            extra = [(h, self.merge(data[h : h + n].tobytes())) for h, n in zip(head[alone].tolist(), size[alone].tolist())]
            # The ids of a long fragment take places from its first byte on: it has no more ids than bytes.
            ids = np.concatenate([ids, *(np.array(x, np.int64) for _, x in extra)])
            place = np.concatenate([place, *(np.arange(h, h + len(x)) for h, x in extra)])
            order = np.argsort(place, kind="stable")
            ids, place = ids[order], place[order]
        else:
            ids, place = self.merge_all(data, start)
        bounds = np.searchsorted(place, np.append(begin, len(data))).tolist()
        ids = ids.tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str) -> list[int]:
        return next(Encoder(self).encode([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def slices(self, text: str) -> Iterable[int | list[str]]:
        """Special tokens as ids; what lies between them as lists of pieces.

        A piece stands for itself with a space before it; if none is before it, its name starts with a space.
        """
        for part in self.parts.split(text) if self.parts is not None and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield self.special[part]
                continue
            at, first = 0, True
            while at < len(part):
                end = CUT.search(part, at + SLICE_CHARS) if len(part) - at > SLICE_CHARS else None
                end = end.start() if end else len(part)
                some = part[at:end] if first else part[at + 1 : end]
                found = CUT.split(some) if ODD.search(some) else some.split(" ")
                if first and found[0]:
                    found[0] = " " + found[0]
                yield found[first and not found[0] :]
                at, first = end, False


class Pieces:
    """What is kept of each piece. makes: of each table, what it keeps of a pre-token's ids, and how that is joined to a piece's."""

    def __init__(self, codec: Codec, *makes):
        self.codec, self.makes = codec, makes
        self.tables: list[dict[str, object]] = [{} for _ in makes]
        self.passing: list[str] = []

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes those that aren't known, all together."""
        new = [p for p in set(pieces) if p not in self.tables[0]]
        if not new:
            return
        # A plain word is one pre-token with its space; others are split where they stand side by side, as nothing is matched across.
        plain = [p for p in new if p.isascii() and p.isalpha()]
        first = [p for p in new if p[0] == " "]
        other = [p for p in new if p[0] != " " and not (p.isascii() and p.isalpha())]
        found = self.codec.words.findall(" " + " ".join(other)) if other else []
        at = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), np.cumsum([1 + len(p) for p in other], dtype=np.int64)) + 1
        spread = [found[a:b] for a, b in zip([0, *at.tolist()], at.tolist())]
        for p in first:
            spread.append(self.codec.words.findall(p[1:]))
        words = [" " + p for p in plain]
        distinct = list(dict.fromkeys(chain(words, chain.from_iterable(spread))))
        ids = self.codec.encode_words(distinct)
        for table, (make, join) in zip(self.tables, self.makes):
            by_word = dict(zip(distinct, map(make, ids)))
            table.update(zip(plain, map(by_word.__getitem__, words)))
            table.update((p, join(map(by_word.__getitem__, own))) for p, own in zip(chain(other, first), spread))
        self.passing += [p for p in new if len(p) > CACHE_CHARS]

    def trim(self) -> None:
        """Between groups of texts: long pieces go, and all of them if there are too many."""
        full = len(self.tables[0]) > CACHE_PIECES
        for table in self.tables:
            if full:
                table.clear()
            for p in self.passing:
                table.pop(p, None)
        self.passing = []


class Encoder:
    """Encodes batches of texts, to ids or to digests."""

    def __init__(self, codec: Codec):
        self.codec, names, raw = codec, list(map(str, range(codec.base))), codec.bytes_of
        self.ids = Pieces(codec, (tuple, lambda parts: tuple(chain.from_iterable(parts))))
        self.shown = Pieces(codec, (lambda ids: ",".join([names[i] for i in ids]), ",".join), (lambda ids: b"".join([raw[i] for i in ids]), b"".join))

    def _groups(self, cache: Pieces, texts: Iterable[str]):
        """Each text's slices with all their pieces known; texts of about SLICE_CHARS are learned from together."""
        group, size = [], 0
        for text in texts:
            if size + len(text) > SLICE_CHARS and group:
                yield from self._learned(cache, group)
                group, size = [], 0
            if len(text) > SLICE_CHARS:
                yield self._one_by_one(cache, text)
                continue
            group.append(list(self.codec.slices(text)))
            size += len(text)
        yield from self._learned(cache, group)

    @staticmethod
    def _learned(cache: Pieces, group: list):
        cache.trim()
        cache.learn(chain.from_iterable(s for slices in group for s in slices if not isinstance(s, int)))
        yield from group

    def _one_by_one(self, cache: Pieces, text: str):
        for s in self.codec.slices(text):
            if not isinstance(s, int):
                cache.trim()
                cache.learn(s)
            yield s

    def encode(self, texts: Iterable[str]):
        """The ids of each text."""
        for slices in self._groups(self.ids, texts):
            out: list[int] = []
            for s in slices:
                if isinstance(s, int):
                    out.append(s)
                else:
                    out += chain.from_iterable(map(self.ids.tables[0].__getitem__, s))
            yield out

    def digests(self, texts: Iterable[str]):
        """(number of tokens, digest of the ids, digest of the decoded text) of each text."""
        of_ids, of_bytes = self.shown.tables
        for slices in self._groups(self.shown, texts):
            n, ids, back = 0, hashlib.sha256(), Decoded()
            for s in slices:
                if isinstance(s, int):
                    shown, data = str(s), self.codec.bytes_of[s]
                else:
                    shown, data = ",".join(map(of_ids.__getitem__, s)), b"".join(map(of_bytes.__getitem__, s))
                ids.update(("," + shown if n else shown).encode())
                back.add(data)
                n += shown.count(",") + 1
            yield n, ids.hexdigest(), back.hexdigest()


class Decoded:
    """The digest of bytes as the text they stand for; what isn't UTF-8 becomes the replacement character."""

    def __init__(self):
        self.decoder, self.sha = codecs.getincrementaldecoder("utf-8")("replace"), hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.sha.update(self.decoder.decode(data).encode("utf-8"))

    def hexdigest(self) -> str:
        self.sha.update(self.decoder.decode(b"", True).encode("utf-8"))
        return self.sha.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all batches of a Python worker."""
    return Encoder(codec(path))


def encode(text: Column, path: str | None = None) -> Column:
    """The token ids of a text column, as array<int>; null texts give an empty array."""
    where = path or default_path()

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(ids, np.int32) for ids in encoder(where).encode(t or "" for t in texts)], dtype=object)

    return run(text)


def encode_checked(text: Column, path: str | None = None) -> Column:
    """struct<ids array<int>, decoded_sha256>: the ids, and the digest of what they decode to."""
    where = path or default_path()

    @F.pandas_udf("ids array<int>, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows, c = [], codec(where)
        for ids in encoder(where).encode(t or "" for t in texts):
            rows.append((np.array(ids, np.int32), hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest()))
        return pd.DataFrame(rows, columns=["ids", "decoded_sha256"])

    return run(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a column of token ids; null gives an empty text."""
    where = path or default_path()

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        c = codec(where)
        return rows.map(lambda r: c.decode([] if r is None else list(r)))

    return run(ids)


def digest(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of the whole text; a null text counts as empty.

    One narrow pass: no shuffle, and a task holds one Arrow batch and the bounded cache of pieces. Columns of docs
    by the names of the three added ones are replaced.
    """
    arrow_batches(docs.sparkSession)
    where = path or default_path()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(encoder(where).digests(texts)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return with_struct(docs, run(text_or_empty(text)), ["n_tokens", "ids_sha256", "decoded_sha256"])

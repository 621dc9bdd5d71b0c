"""Media columns: signature sniffing, type correction, carving, and lossless payload storage.

One Aho-Corasick pass finds every magic byte string; a validator of each format then walks the structure
and its lengths, so a chance hit of a few bytes isn't taken for a file. The type that validates at offset 0
replaces the declared one; whatever validates further in is carved out. Null bytes are an empty value, and
an empty or unknown value keeps no type (`unknown`). Formats without end marks end where their lengths say. Equal
values get equal results, row by row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_batches, text_or_empty, with_struct

#: Magic bytes by format.
MAGIC = {
    "bmp": [b"BM"],
    "flac": [b"fLaC"],
    "gif": [b"GIF87a", b"GIF89a"],
    "jpeg": [b"\xff\xd8\xff"],
    "ogg": [b"OggS"],
    "pdf": [b"%PDF-"],
    "png": [b"\x89PNG\r\n\x1a\n"],
    "riff": [b"RIFF"],
    "zip": [b"PK\x03\x04"],
}

#: Payloads are padded with zero bytes to a positive multiple of this.
BLOCK = 64
SAMPLE_RATE = 8000


def _png(b: bytes, at: int) -> int:
    k, first = at + 8, True
    while k + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, k)
        if k + 12 + n > len(b) or first != (kind == b"IHDR") or first and n != 13:
            return 0
        if zlib.crc32(memoryview(b)[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return 0
        k, first = k + 12 + n, False
        if kind == b"IEND":
            return k
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    k = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(k: int) -> int:
        while k < len(b) and b[k]:
            k += b[k] + 1
        return k + 1

    while k < len(b):
        if b[k] == 0x3B:
            return k + 1
        if b[k] == 0x21:
            k = blocks(k + 2)
        elif b[k] == 0x2C and k + 10 < len(b):
            k = blocks(k + 11 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        mark = b[k + 1]
        if mark == 0xD9:
            return k + 2
        if mark in (0x00, 0x01, 0xFF) or 0xD0 <= mark <= 0xD8:
            return 0
        k += 2 + struct.unpack_from(">H", b, k + 2)[0]
        if mark == 0xDA:  # coded data up to the next mark that isn't a stuffed byte or a restart
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b) and (b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7):
                k += 2
            if k < 0:
                return 0
    return k + 2 if k + 2 <= len(b) and b[k : k + 2] == b"\xff\xd9" else 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP"):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    k = at + 12
    while k + 8 <= end:
        k += 8 + (n := struct.unpack_from("<I", b, k + 4)[0]) + n % 2
    return end if k == end else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    return at + size if header in (12, 40, 52, 56, 108, 124) and planes == 1 and 14 + header <= start <= size <= len(b) - at else 0


def _ogg(b: bytes, at: int) -> int:
    k = at
    while k + 27 <= len(b) and b[k : k + 5] == b"OggS\0":
        n = b[k + 26]
        if k + 27 + n > len(b) or (end := k + 27 + n + sum(b[k + 27 : k + 27 + n])) > len(b):
            return 0
        last, k = b[k + 5] & 4, end
        if last:
            return k
    return 0


def _flac(b: bytes, at: int) -> int:
    k = at + 4
    while k + 4 <= len(b):
        head, n = b[k], int.from_bytes(b[k + 1 : k + 4], "big")
        if k == at + 4 and (head & 127 or n != 34):
            return 0
        k += 4 + n
        if head & 128:  # frames follow without a length: they reach to the end
            return len(b) if k + 2 <= len(b) and b[k] == 0xFF and b[k + 1] & 0xFC == 0xF8 else 0
    return 0


def _zip(b: bytes, at: int) -> int:
    k = at
    while (k := b.find(b"PK\x05\x06", k)) >= 0 and k + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, k + 12)
        if at + start + size == k and k + 22 + note <= len(b) and (not size or b[at + start : at + start + 4] == b"PK\x01\x02"):
            return k + 22 + note
        k += 4
    return 0


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at)
    return end + 5 if end >= 0 and b.find(b"startxref", at, end) >= 0 and b[at + 5 : at + 6].isdigit() else 0


#: The end of the value that starts at an offset, or 0 if the structure or its lengths are wrong.
VALID = {"bmp": _bmp, "flac": _flac, "gif": _gif, "jpeg": _jpeg, "ogg": _ogg, "pdf": _pdf, "png": _png, "riff": _riff, "zip": _zip}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for m in magics:
            found.add_word(m.decode("latin-1"), (kind, len(m)))
    found.make_automaton()
    return found


def kind_at(b: bytes, at: int, kind: str) -> str:
    return {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}[b[at + 8 : at + 12]] if kind == "riff" else kind


def carve(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every valid value, outermost first; what lies inside another isn't listed."""
    out, upto = [], 0
    for last, (kind, n) in automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at >= upto and (end := VALID[kind](data, at)):
            out.append((kind_at(data, at, kind), at, end))
            upto = end
    return out


def sniff(data: bytes | None, declared: str | None = None) -> tuple[str, bool]:
    """The type that validates at offset 0 (else `unknown`), and whether the declared one had to be corrected."""
    data, kind = data or b"", "unknown"
    for name, magics in MAGIC.items():
        if data.startswith(tuple(magics)) and VALID[name](data, 0):
            kind = kind_at(data, 0, name)
    return kind, kind != (declared or "unknown")


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM; each byte is a sample. Payloads are of even length here, so no pad byte follows."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The sample bytes of a stored wav: found by sniffing and walking its chunks."""
    if sniff(media)[0] != "wav":
        raise ValueError("not a valid wav")
    k = 12
    while media[k : k + 4] != b"data":
        n = struct.unpack_from("<I", media, k + 4)[0]
        k += 8 + n + n % 2
    return media[k + 8 : k + 8 + struct.unpack_from("<I", media, k + 4)[0]]


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def features(payload: bytes) -> str:
    """Whole numbers of the samples: lowest, highest, sum, centre crossings, distinct values, carved values."""
    x = np.frombuffer(payload, np.uint8)
    high = x >= 128
    counts = np.bincount(x, minlength=256)
    return f"wav:u8:{SAMPLE_RATE};min={x.min()};max={x.max()};sum={int(counts @ np.arange(256))};cross={int((high[1:] != high[:-1]).sum())};distinct={int((counts > 0).sum())};carved={len(carve(payload))}"


def store(text: str | None) -> dict:
    data = (text or "").encode("utf-8", "surrogatepass")
    media = wav(pad(data))
    back = samples(media)
    return {
        "n_bytes": len(data),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-BLOCK:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": features(back),
    }


def inspect(data: Column, declared: Column) -> Column:
    """struct<kind, corrected, carved array<struct<kind,start,end>>> of a binary column with declared types."""

    @F.pandas_udf("kind string, corrected boolean, carved array<struct<kind:string,start:long,end:long>>")
    def run(values: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for v, name in zip(values, names):
            kind, corrected = sniff(v, name)
            rows.append((kind, corrected, [{"kind": k, "start": s, "end": e} for k, s, e in carve(v or b"")]))
        return pd.DataFrame(rows, columns=["kind", "corrected", "carved"])

    return run(data, declared)


def media_column(text: Column) -> Column:
    """The stored form (wav bytes) of a text column; null is stored as the empty text is."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wav(pad((t or "").encode("utf-8", "surrogatepass"))))

    return run(text)


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores every whole text as media, reads it back, and adds the digest columns. One narrow pass."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([store(t) for t in texts], columns=COLUMNS)

    return with_struct(docs, run(text_or_empty(text)), COLUMNS)

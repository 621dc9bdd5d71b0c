"""Language identification with a bidirectional gated recurrent network over bytes.

A text is its lower-cased UTF-8 bytes, words, spaces and signs alike. Both directions run over whole texts, in
windows of BLOCK bytes that don't depend on each other: in each direction the network has read the MARGIN bytes
beyond the window first, so every position sees what stands around it, across words and window edges. Every byte
position gets a probability for each language; a document's probability is the mean over all its positions. The
network is trained here, in numpy, by backpropagation through time, on whole texts of a bounded number of rows.

Texts that are null or hold no letter get `und` with score 0; if no row carries a language, so does every text.
Ties between languages go to the first by name; equal texts get equal results, so do rows that repeat an id; an
empty table gives none; other columns stay, but for those of the names that are added.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_batches, crc_mod, text_or_empty, with_struct

#: At most so many rows are learned from, those of the smallest hash of their id, with their whole texts.
TRAIN_ROWS = 300
#: Bytes of a window, those read before and after it, and of a window that is trained on.
BLOCK, MARGIN, TRAIN_BLOCK = 464, 48, 64
HIDDEN, BATCH, RATE, SEED = 8, 512, 0.02, 11
#: Passes over the sample, and updates at least, so that small samples are seen more often.
EPOCHS, UPDATES = 4, 120
#: Windows that run side by side, and that are held at once.
RUN_ROWS, HELD_ROWS = 1024, 8192
UNKNOWN = "und"


def data_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(data: bytes, block: int = BLOCK) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, start, end) of each window with its margins, and where in them its own positions are."""
    for at in range(0, len(data), block):
        low = max(0, at - MARGIN)
        yield data[low : at + block + MARGIN], at - low, min(at + block, len(data)) - low


def pack(rows: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by position and row, the lengths, and which positions count. Rows are sorted by falling length; 0 fills up."""
    n = np.fromiter((len(r[0]) for r in rows), np.int64, len(rows))
    out = np.zeros((len(rows), int(n.max())), np.uint8)
    places = np.arange(out.shape[1])
    out[places < n[:, None]] = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    start, end = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in (1, 2))
    return np.ascontiguousarray(out.T), n, ((places[:, None] >= start) & (places[:, None] < end)).astype(np.float32)


@dataclass
class Network:
    """For each direction: input weights by byte, recurrent weights, bias; then the output layer."""

    languages: list[str]
    x: list[np.ndarray]
    h: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str]) -> "Network":
        rng, n = np.random.default_rng(SEED), HIDDEN
        make = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        return cls(languages, [make(256, 3 * n) * 0.3 for _ in "fb"], [make(n, 3 * n) / np.sqrt(n) for _ in "fb"], make(2 * n, len(languages)) / np.sqrt(2 * n), np.zeros(len(languages), np.float32))

    def direction(self, d: int, data: np.ndarray, n: np.ndarray, logits: np.ndarray, kept: list | None = None) -> None:
        """Adds a direction's share of the logits, by position, row and language. kept: gets what backpropagation needs.

        Arrays have a row for each unit and a column for each window, so that the gates are contiguous.
        """
        size = HIDDEN
        x, wh, wo = np.ascontiguousarray(self.x[d].T), np.ascontiguousarray(self.h[d].T), self.out[d * size : (d + 1) * size]
        h = np.zeros((size, data.shape[1]), np.float32)
        live = (np.arange(data.shape[0])[:, None] < n).sum(axis=1)  # windows that reach a position
        for t in range(data.shape[0]) if d == 0 else range(data.shape[0] - 1, -1, -1):
            m = live[t]
            old = h[:, :m]
            a, r = np.take(x, data[t, :m], axis=1), wh @ old
            gates = a[: 2 * size]
            gates += r[: 2 * size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, g = gates[:size], gates[size:]  # update, reset
            c = g * r[2 * size :]
            c += a[2 * size :]
            np.tanh(c, out=c)
            new = old - c
            new *= z
            new += c
            if kept is not None:
                kept.append((t, m, old.copy(), z, g, c, r[2 * size :], new.copy()))
            h[:, :m] = new
            logits[t, :m] += new.T @ wo

    def probabilities(self, data: np.ndarray, n: np.ndarray, kept: tuple = (None, None)) -> np.ndarray:
        """By position, row and language."""
        logits = np.tile(self.bias, (*data.shape, 1))
        for d in (0, 1):
            self.direction(d, data, n, logits, kept[d])
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def sums(self, rows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """The probabilities of each window, summed over its own positions."""
        out = np.zeros((len(rows), len(self.languages)), np.float64)
        order = np.argsort([-len(r[0]) for r in rows], kind="stable")
        for k in range(0, len(order), RUN_ROWS):
            part = order[k : k + RUN_ROWS]
            data, n, counts = pack([rows[k] for k in part])
            out[part] = (self.probabilities(data, n) * counts[:, :, None]).sum(axis=0)
        return out

    def step(self, rows: list[tuple[bytes, int, int]], labels: np.ndarray, moments: list, count: int) -> float:
        """One update by backpropagation through time; every position that counts carries the label of its row."""
        size = HIDDEN
        order = np.argsort([-len(r[0]) for r in rows], kind="stable")
        data, n, mask = pack([rows[k] for k in order])
        y = labels[order]
        kept: tuple[list, list] = ([], [])
        p = self.probabilities(data, n, kept)
        each = np.arange(data.shape[1])
        loss = -(np.log(p[:, each, y] + 1e-9) * mask).sum() / mask.sum()
        delta = p
        delta[:, each, y] -= 1
        delta *= (mask / mask.sum())[:, :, None]
        grads = [np.zeros_like(v) for v in (*self.x, *self.h, self.out, self.bias)]
        grads[5] += delta.sum(axis=(0, 1))
        for d in (0, 1):
            wo, wh, out = self.out[d * size : (d + 1) * size], self.h[d], grads[4][d * size : (d + 1) * size]
            dh = np.zeros((size, data.shape[1]), np.float32)
            seen, deltas = [], []
            for t, m, old, z, g, c, rc, new in reversed(kept[d]):
                out += new @ delta[t, :m]
                dn = dh[:, :m] + wo @ delta[t, :m].T
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (old - c) * z * (1 - z)
                dg = dc * rc * g * (1 - g)
                dr = np.concatenate([dz, dg, dc * g])
                seen.append(data[t, :m])
                deltas.append(np.concatenate([dz, dg, dc]).T)
                grads[2 + d] += old @ dr.T
                dh[:, :m] = dn * z + wh @ dr
            at = np.concatenate(seen)
            by_byte = np.argsort(at, kind="stable")
            values, first = np.unique(at[by_byte], return_index=True)
            grads[d][values] = np.add.reduceat(np.concatenate(deltas)[by_byte], first)
        for value, grad, (first, second) in zip([*self.x, *self.h, self.out, self.bias], grads, moments):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value -= RATE * (first / (1 - 0.9**count)) / (np.sqrt(second / (1 - 0.99**count)) + 1e-6)
        return float(loss)


def fit(texts: list[str], labels: list[str]) -> Network:
    """Trains on the whole labelled texts."""
    languages = sorted(set(labels))
    net = Network.fresh(languages)
    rows, y = [], []
    for text, label in zip(texts, labels):
        if has_letter(text):
            own = list(windows(data_of(text), TRAIN_BLOCK))
            rows += own
            y += [languages.index(label)] * len(own)
    if len(languages) < 2 or not rows:
        return net
    y, rng = np.array(y), np.random.default_rng(SEED)
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in [*net.x, *net.h, net.out, net.bias]]
    count, each = 0, max(1, len(rows) // BATCH)
    for _ in range(max(EPOCHS, -(-UPDATES // each))):
        for batch in np.array_split(rng.permutation(len(rows)), each):
            count += 1
            net.step([rows[k] for k in batch], y[batch], moments, count)
    return net


def pooled(net: Network, texts: list[str]) -> list[tuple[str, float]]:
    """The language of each whole text, and its probability."""
    total, length = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts), np.int64)
    lettered = [bool(net.languages) and has_letter(t) for t in texts]
    rows: list[tuple[bytes, int, int]] = []
    owner: list[int] = []

    def run() -> None:
        if rows:
            np.add.at(total, owner, net.sums(rows))
            rows.clear()
            owner.clear()

    for k, text in enumerate(texts):
        if lettered[k]:
            data = data_of(text)
            length[k] = len(data)
            for w in windows(data):
                rows.append(w)
                owner.append(k)
                if len(rows) >= HELD_ROWS:
                    run()
    run()
    out = []
    for k, known in enumerate(lettered):
        p = total[k] / max(1, length[k])
        out.append((net.languages[int(p.argmax())], float(min(1.0, p.max()))) if known else (UNKNOWN, 0.0))
    return out


def held_out(column: str = "doc_id"):
    """The fold that is never learned from."""
    return crc_mod(column, 3) == 1


def train(docs: DataFrame, limit: int = TRAIN_ROWS) -> Network:
    """Learns from the whole texts of at most `limit` rows with a language. docs: doc_id, text, lang."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).distinct()
    # Texts of the picked ids alone reach the sort: at most `limit` of them, which may be broadcast, leave it.
    some = usable.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id")
    found = some.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit).toPandas()
    found = found.drop_duplicates(["lang", "text"])
    return fit(list(found["text"]), list(found["lang"]))


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds lang_pred and score; one narrow pass over whole texts."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(pooled(net, list(texts)), columns=["lang_pred", "score"])

    return with_struct(docs, run(text_or_empty(text)), ["lang_pred", "score"])

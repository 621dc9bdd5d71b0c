"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from exact patterns and always stay. Further candidates are tokens
that hold a digit, and local telephone numbers. Four labelers vote on each candidate (1 personal, -1 not, 0
no opinion): its form, a gazetteer (tables of key prefixes, of account numbers by country, of neutral words), the words before it, and its mix of
characters. Votes are counted by pattern (at most 81 x the feature combinations below, whatever the input),
expectation-maximisation on these counts estimates how reliable each labeler is, and a logistic classifier
over span features, trained on the posteriors, makes the final decision, as an expression that runs where
the text is. Nothing but the counts leaves the executors.

A null text is empty; a text without candidates keeps its base spans. Candidates that overlap a base span
aren't added; spans that start together are in the order of their kinds. Equal texts get equal spans, and rows
that repeat an id or a text get theirs row by row; an empty table gives none. Patterns use possessive loops, and
positions are summed up by blocks of matches, so long texts are read in about linear time. Other columns stay,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, text_or_empty

#: The base patterns, rewritten so that they match the same spans without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"

#: Candidates: tokens of ten characters or more with a digit, and local telephone numbers.
CANDIDATE = r"(?<![A-Za-z0-9_/+-])(?:(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{10,}+|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]))"
CONTEXT_CHARS = 30

#: Fixed values of the labelers.
FORM_YES = r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|(?:AKIA|ASIA)[A-Z0-9]{16}|(?=[0-9]*[a-f])[0-9a-f]{16,}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})$"
FORM_NO = r"^(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{10}|[A-Za-z]+-[0-9]{1,3})$"
#: Gazetteer: the first four characters of access keys; the lengths of account numbers (IBAN) by country; heads of neutral codes.
KEY_HEADS = "AKIA ASIA ghp_ gho_ ghs_ ghu_ glpa npm_ pk_l pk_t rk_l rk_t shpa sk_l sk_t xoxa xoxb xoxp AIza eyJh ya29".split()
ACCOUNT_LENGTHS = dict(
    (x[:2], int(x[2:]))
    for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 VG24 XK20".split()
)
NEUTRAL_HEADS = "ascii asin cc covid css doi ean gpl html http https ipv isbn iso issn md rfc sha unicode upc utf".split()
CONTEXT_YES = r"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api[_ -]?key|access[_ -]?key|ssn|social security|iban|account|passport|licen[cs]e no|tel|phone|call|mobile|fax)[ .:=\"'#]{0,6}$"
CONTEXT_NO = r"(?i)(?:version|page|chapter|section|figure|table|isbn|doi|released?|no\.)[ .:#]{0,4}$"
MIX_YES = r"^(?:[A-Za-z_/+-]*[0-9]+[A-Za-z]+[0-9]+[A-Za-z]+[0-9])"
MIX_NO = r"^[A-Za-z_/+-]+[0-9]{1,4}$"
LABELERS = ("form", "gazetteer", "context", "mix")

#: Spans with at least this probability are added.
DECIDE = 0.5
EM_ROUNDS, TRAIN_ROUNDS = 60, 400
SPAN = "struct<start:int,end:int,text:string,before:string>"


#: Items of an array that are scanned in one go.
STRIDE = 64


def scan(items: Column, value, combine, zero: Column, emit, out: str) -> Column:
    """emit(so far, item) of each item, where `so far` combines the values of those before it.

    Totals of blocks of STRIDE items come first, so no array of more than STRIDE items grows item by item, but for one
    with an entry for each block.
    """
    none = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{out}>").alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STRIDE).cast("int")), lambda k: F.slice(items, k * STRIDE + 1, STRIDE))
    totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda acc, x: combine(acc, value(x))))
    kind = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(totals, kind, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    step = lambda acc, x: F.struct(combine(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out"))
    whole = F.flatten(F.zip_with(parts, starts, lambda p, at: F.aggregate(p, none(at), step, lambda acc: acc["out"])))
    return F.when(F.size(items) > 0, whole).otherwise(F.array().cast(f"array<{out}>"))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start and end in code points, the match, the characters before it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"), F.substring(x["gap"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = scan(pairs, lambda x: F.length(x["gap"]) + F.length(x["hit"]), lambda a, b: a + b, F.lit(0), span, SPAN)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check; the rightmost digit counts once, the next twice, and so on."""
    n = F.length(number)

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(number, n - k + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span["text"].rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits(span["text"])).between(12, 19), luhn(digits(span["text"]))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(span["text"])).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = matches(text, BASE[kind])
    if kind == "card":  # a cheap test first: most texts hold no run of twelve digits
        found = F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), found).otherwise(F.array().cast(f"array<{SPAN}>"))
    return F.filter(found, lambda s: valid(kind, s))


def vote(value: Column, yes: str, no: str) -> Column:
    return F.when(value.rlike(yes), 1).when(value.rlike(no), -1).otherwise(0)


def listed(word: Column) -> Column:
    """The gazetteer's vote, by look-up."""
    lengths = F.create_map(*(F.lit(x) for pair in ACCOUNT_LENGTHS.items() for x in pair))
    account = F.element_at(lengths, F.substring(word, 1, 2)) == F.length(word)
    head = F.lower(F.regexp_extract(word, "^[A-Za-z]+", 0))
    return F.when(F.substring(word, 1, 4).isin(*KEY_HEADS) | F.coalesce(account, F.lit(False)), 1).when(head.isin(*NEUTRAL_HEADS), -1).otherwise(0)


def judged(span: Column) -> Column:
    """The votes of the labelers and the features of the classifier."""
    word = span["text"]
    votes = (vote(word, FORM_YES, FORM_NO), listed(word), vote(span["before"], CONTEXT_YES, CONTEXT_NO), vote(word, MIX_YES, MIX_NO))
    flags = (
        word.rlike("^[0-9]+$"),
        word.rlike("^[0-9a-f]+$"),
        word.rlike("^[A-Z0-9]+$"),
        word.rlike("[ ._/+-]"),
        F.length(word) >= 16,
        F.length(word) >= 24,
        span["before"].rlike(CONTEXT_YES),
        span["before"].rlike("[=:\"'] ?$"),
    )
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.array(*votes).alias("votes"), F.array(*(f.cast("int") for f in flags)).alias("flags"))


N_FLAGS = 8


def candidates(text: Column) -> Column:
    return F.transform(matches(text, CANDIDATE), judged)


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """The probability of each vote pattern to be personal. For each labeler and class, the probabilities of its three votes."""
    if not counts:
        return {}
    share = 0.5
    model = [[{1: 0.15, 0: 0.5, -1: 0.35}, {1: 0.5, 0: 0.4, -1: 0.1}] for _ in LABELERS]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(EM_ROUNDS):
        for votes, _n in counts:
            like = [1 - share, share]
            for k, v in enumerate(votes):
                like = [like[c] * model[k][c][v] for c in (0, 1)]
            post[votes] = like[1] / (like[0] + like[1])
        total = sum(n for _, n in counts)
        share = min(max(sum(post[v] * n for v, n in counts) / total, 0.01), 0.99)
        for k in range(len(LABELERS)):
            for c in (0, 1):
                mass = {v: 1e-2 * total * (1.5 if (v > 0) == bool(c) and v else 0.5) for v in (-1, 0, 1)}
                for votes, n in counts:
                    mass[votes[k]] += n * (post[votes] if c else 1 - post[votes])
                whole = sum(mass.values())
                model[k][c] = {v: m / whole for v, m in mass.items()}
    return post


def fit(rows: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> list[float]:
    """Logistic regression on the posteriors: the bias, then a weight for each flag. rows: votes, flags, count."""
    by_votes: dict[tuple[int, ...], int] = {}
    for votes, _, n in rows:
        by_votes[votes] = by_votes.get(votes, 0) + n
    post = expectation_maximisation(sorted(by_votes.items()))
    by_flags: dict[tuple[int, ...], list[float]] = {}
    for votes, flags, n in rows:
        at = by_flags.setdefault(flags, [0.0, 0.0])
        at[0] += n
        at[1] += n * post[votes]
    w, total = [0.0] * (N_FLAGS + 1), sum(n for n, _ in by_flags.values()) or 1.0
    scale = [1e-6] * len(w)
    for _ in range(TRAIN_ROUNDS if by_flags else 0):
        grad = [1e-4 * x for x in w]
        for flags, (n, y) in by_flags.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(x for x, f in zip(w[1:], flags) if f)))))
            grad[0] += (n * p - y) / total
            for k, f in enumerate(flags):
                if f:
                    grad[k + 1] += (n * p - y) / total
        for k, g in enumerate(grad):
            scale[k] += g * g
            w[k] -= 0.3 * g / math.sqrt(scale[k])
    return w if by_flags else [-1.0, *w[1:]]


def train(docs: DataFrame) -> list[float]:
    """Weights of the span classifier, from the counts over all texts."""
    found = docs.select(F.explode(candidates(text_or_empty())).alias("c")).groupBy("c.votes", "c.flags").count()
    return fit(sorted((tuple(r[0]), tuple(r[1]), r[2]) for r in found.collect()))  # at most 81 x 2^8 rows


KINDS = ("email", "ip", "card", "phone", "secret")


def ranks(spans, n: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def with_spans(docs: DataFrame, weights: list[float], text: Column | None = None) -> tuple[DataFrame, str, str]:
    """(docs with two more columns, their names): base spans, and all spans, by start and then kind."""
    text = text_or_empty() if text is None else text
    own = [F.col(f"`{c}`") for c in docs.columns]
    kinds = [k for k in KINDS if k in BASE]
    names = {k: free_name(docs, k) for k in (*kinds, "more", "base", "all")}
    found = docs.select(*own, *(base_spans(text, k).alias(names[k]) for k in kinds), candidates(text).alias(names["more"]))
    ranked = [ranks(names[k], n, k) for n, k in enumerate(kinds)]
    base, more = names["base"], names["more"]
    found = found.select(*own, more, F.array_sort(F.concat(*ranked)).alias(base))
    logit = lambda c: F.lit(weights[0]) + sum((c["flags"][k] * F.lit(w) for k, w in enumerate(weights[1:])), F.lit(0.0))
    cut = math.log(DECIDE / (1 - DECIDE))
    kept = F.filter(more, lambda c: (logit(c) >= F.lit(cut)) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    extra = ranks(kept, len(kinds), KINDS[-1])
    return found.select(*own, base, F.array_sort(F.concat(base, extra)).alias(names["all"])), base, names["all"]


def shown(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, weights: list[float]) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans."""
    found, base, spans = with_spans(docs, weights)
    counts = [F.size(of_kind(base, k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"))


def redact(docs: DataFrame, weights: list[float], text: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in brackets; overlapping spans become one. A null text stays null."""
    whole = F.col(f"`{text}`")
    found, _, spans = with_spans(docs, weights, text_or_empty(text))

    def piece(at: Column, s: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(F.substring(whole, at + 1, s["start"] - at), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

    pieces = scan(F.col(spans), lambda s: s["end"], lambda a, b: F.greatest(a, b), F.lit(0), piece, "string")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    done = F.concat(F.array_join(pieces, ""), F.substring(whole, last + 1, F.length(whole)))
    return found.select(*(F.when(F.size(spans) > 0, done).otherwise(whole).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))

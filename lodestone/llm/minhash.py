"""MinHash near-duplicate detection with sequential Bayesian verification.

A text is the set of its distinct SHINGLE-word runs (A-Z lowered). Texts of equal sets are one class, found
by a digest of the set, so copies cost nothing more. Classes whose signatures agree on a whole band are
candidates. Within a band bucket nobody is paired with everybody: each member meets the bucket's leader L.
Pairs inside one component needn't be compared. Two members x, y of a bucket that are still apart can only be
similar if they differ from L in the same way: one of them, x, isn't similar to L, so with A = own shingles
that L lacks and B = those of L that it lacks, at least (t |A_y| + |B_y|) / (1 + t) elements of A and B are
common to both (t is the threshold; put the sizes into the Jaccard quotient). So members meet on the rarest of
their differences from L, as many as this bound leaves (a prefix filter), and early enough among them for the
rest to suffice (a positional filter), and components stay exact, while copies that each differ in their own way
hardly meet.

A candidate's signatures are compared batch by batch; after each batch the pair is given up if the posterior
probability of a similarity of num/DEN or more has fallen below MISS (uniform prior). What survives is verified
on the full sets, in whole numbers. n_bands x ROWS miss a pair at the threshold with probability
(1 - (num/DEN)**ROWS)**n_bands = 3e-7, and any one at a higher similarity less often: 26 bands for the 85/100 of
op6, 38 for the 80/100 of the pipeline.

Null, empty and wordless texts have no set and stay alone; texts of fewer words than SHINGLE are one shingle.
Rows that repeat an id count as one vertex; every row without an id is a vertex of its own after all ids, and
components of such rows alone have no id: all of them stay. Ids that aren't whole numbers are taken in their own
order. An empty table gives none; other columns stay where rows are kept, and aren't read.
"""

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Staged, arrow_batches, free_name, named, text_or_empty, whole_ids
from lodestone.llm.components import components
from lodestone.llm.grams import WordHash, grams, hashes

SHINGLE, NUM, DEN = 5, 85, 100
BANDS, ROWS = 26, 5
#: Threshold (of DEN) and bands of the pipeline's stage.
STAGE_NUM, STAGE_BANDS = 80, 38
MISS = 1e-7
SEED = 5

WORD = re.compile(r"[^\x20\x09-\x0D]+")

_RNG = np.random.default_rng(SEED)
FACTOR, SHIFT = _RNG.integers(0, 2**63, (STAGE_BANDS * ROWS, 2), dtype=np.uint64).T.copy()
FACTOR = FACTOR * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[str]:
    """Lower-cases A-Z only: bytes know no other case."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def shingles(known: WordHash, text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = words(text)
    return np.unique(grams(hashes(known, found), min(SHINGLE, len(found)))) if found else np.empty(0, np.uint64)


def signature(s: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """The smallest value of each hash function over a set, as 32-bit numbers."""
    out = np.empty(n_bands * ROWS, np.uint64)
    step = max(1, 60_000 // len(s))
    for k in range(0, len(out), step):
        values = s[None, :] * FACTOR[k : min(k + step, len(out)), None]
        values += SHIFT[k : min(k + step, len(out)), None]
        out[k : k + step] = values.min(axis=1)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(n: int, threshold: float, miss: float = MISS) -> int:
    """The fewest equal values among n for which the posterior of similarity >= threshold is at least miss.

    With a uniform prior, P(similarity >= t | m of n) is the probability of at most m successes in n + 1 trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def numbered(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str, int]:
    """(docs with a vertex column, its name, the largest id): rows without an id get numbers above all ids, and are staged to keep them."""
    vertex = free_name(docs, "vertex")
    top = docs.agg(F.max(F.col(key).cast("long"))).first()[0]
    top = -1 if top is None else top
    nulls = Staged(docs.where(F.col(key).isNull()).withColumn(vertex, F.lit(top + 1).cast("long") + F.monotonically_increasing_id()), "no-id").df
    return docs.where(F.col(key).isNotNull()).withColumn(vertex, F.col(key).cast("long")).unionByName(nulls), vertex, top


def sketch(docs: DataFrame, key: str, text: str, n_bands: int) -> DataFrame:
    """(id, n_shingles, set_key, sig): the size, digest and signature of each whole text's set."""

    @F.pandas_udf("n long, set_key binary, sig binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for texts in batches:
            rows = []
            for t in texts:
                s = shingles(known, t)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s, n_bands).tobytes()) if len(s) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "set_key", "sig"])

    return docs.select(F.col(key).alias("id"), run(text_or_empty(text)).alias("s")).select("id", F.col("s.n").alias("n_shingles"), "s.set_key", "s.sig")


def bands(reps: DataFrame, n_bands: int) -> DataFrame:
    """(band, rep): a row for each band of each class."""
    width = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(n_bands)))
    return reps.select("rep", F.explode(keys).alias("band"))


def plausible(pairs: DataFrame, reps: DataFrame, num: int, n_bands: int) -> DataFrame:
    """The pairs (a, b) that sequential verification of their signatures doesn't rule out."""
    n = n_bands * ROWS
    steps = [(upto, least_matches(upto, num / DEN)) for upto in range(2 * n_bands, n + 1, n_bands)]

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(v), np.uint32).reshape(-1, n) for v in (x, y))
        alive, matches, start = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for upto, least in steps:
            matches[alive] += (a[alive, start:upto] == b[alive, start:upto]).sum(axis=1)
            alive, start = alive[matches[alive] >= least], upto
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pd.Series(out)

    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").where(run("sig_a", "sig_b")).select("a", "b")


def sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(id, items): the sorted shingle hashes of the wanted ids, packed."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordHash()
        for texts in batches:
            yield pd.Series([shingles(known, t).tobytes() for t in texts])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi").select("id", run(text_or_empty()).alias("items"))


def verified(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs whose full sets have DEN x intersection >= num x union."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            out.append(DEN * shared >= num * (len(a) + len(b) - shared))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(left, "a").join(right, "b").where(run("items_a", "items_b")).select("a", "b")


def links(docs: DataFrame, key: str, text: str, reps: DataFrame, pairs: DataFrame, num: int, n_bands: int) -> tuple[Staged, Staged]:
    """(pairs looked at, links among them), both staged."""
    looked = Staged(pairs, "looked")
    alive = Staged(plausible(looked.df, reps, num, n_bands), "alive")
    wanted = alive.df.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = Staged(sets_of(docs, key, text, wanted), "sets")
    found = Staged(verified(alive.df, sets.df, num), "links")
    sets.drop()
    alive.drop()
    return looked, found


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, n_bands: int = BANDS) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs; texts of similarity num/DEN or more are linked."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sketched = Staged(sketch(docs, key, text, n_bands), "sketch")
    firsts = sketched.df.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"))
    reps = Staged(firsts.join(sketched.df.select(F.col("id").alias("rep"), F.col("set_key").alias("__k"), "sig"), "rep").where("set_key = __k").select("rep", "set_key", "sig").dropDuplicates(["rep", "set_key"]), "classes")

    # Buckets of one member lead nowhere; of two, only to the leader.
    kept = bands(reps.df, n_bands).groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1")
    held = Staged(bands(reps.df, n_bands).join(kept, "band"), "bands")

    looked, near = links(docs, key, text, reps.df, _ordered(held.df.select(F.col("low").alias("a"), F.col("rep").alias("b"))), num, n_bands)
    stars = components(near.df.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near.drop()
    members = Staged(_unsettled(held.df.where("n > 2"), stars.df), "unsettled")
    held.drop()
    pairs = Staged(_same_differences(docs, key, text, members.df, num), "pairs")
    members.drop()
    again, more = links(docs, key, text, reps.df, pairs.df.join(looked.df, ["a", "b"], "left_anti"), num, n_bands)
    first, stars = stars, components(stars.df.unionByName(more.df.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    for done in (looked, pairs, again, more, first):
        done.drop()
    by_class = reps.df.select("set_key", "rep").join(stars.df.select(F.col("u").alias("rep"), F.col("v").alias("top")), "rep", "left").select("set_key", F.coalesce("top", "rep").alias("component"))
    return sketched.df.select("id", "n_shingles", "set_key").join(by_class, "set_key", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _unsettled(held: DataFrame, stars: DataFrame) -> DataFrame:
    """(leader, rep, c): members, with their components, of buckets that still hold several."""
    named = held.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("top")), "rep", "left").select("band", "rep", F.col("low").alias("leader"), F.coalesce("top", "rep").alias("c"))
    mixed = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    return named.join(mixed, "band", "left_semi").where("rep <> leader").select("leader", "rep", "c").distinct()


def _differences(own: pd.Series, led: pd.Series, num: int) -> pd.DataFrame:
    """Of sets and their leaders': whether they're not similar; the differences; how many of the rarest of them meet.

    `few` is for partners of a set that is apart: those share more than bound / (num + DEN) differences. `many` is for
    a set that is apart, towards partners that are similar to the leader: they share spare / (num + DEN) at least.
    """
    rows = []
    for x, y in zip(own, led):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        more, less = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
        spare = num * (len(b) + len(more)) - DEN * (len(b) - len(less))  # positive: not similar
        bound = num * len(more) + DEN * len(less)
        n = len(more) + len(less)
        rows.append((spare > 0, n - bound // (num + DEN), n - max(1, -(-spare // (num + DEN))) + 1, bound, (DEN - num) * len(b), np.concatenate([more, ~less]).view(np.int64)))
    return pd.DataFrame(rows, columns=["apart", "few", "many", "bound", "slack", "items"])


def _same_differences(docs: DataFrame, key: str, text: str, members: DataFrame, num: int) -> DataFrame:
    """(a, b): members of one leader, in different components and at least one apart from it, whose rarest differences meet."""

    @F.pandas_udf("apart boolean, few int, many int, bound long, slack long, items array<long>")
    def differences(own: pd.Series, led: pd.Series) -> pd.DataFrame:
        return _differences(own, led, num)

    wanted = members.select(F.explode(F.array("leader", "rep")).alias("id")).distinct()
    sets = Staged(sets_of(docs, key, text, wanted), "sets")
    own, led = sets.df.select(F.col("id").alias("rep"), F.col("items").alias("own")), sets.df.select(F.col("id").alias("leader"), F.col("items").alias("led"))
    split = Staged(members.join(own, "rep").join(led, "leader").select("leader", "rep", "c", differences("own", "led").alias("d")).select("leader", "rep", "c", "d.*"), "differences")
    sets.drop()
    each = split.df.select("leader", "rep", F.explode("items").alias("e"))
    common = each.groupBy("leader", "e").agg(F.count("*").alias("f")).where("f > 1")
    shared = each.join(common, ["leader", "e"]).groupBy("leader", "rep").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("s"))  # at most a set
    alone = F.size("items") - F.size("s")  # differences that nobody else has come first and meet nothing
    # The rarest, each with how many the set shares with anybody from there on.
    rare = lambda n: F.transform(F.slice("s", 1, F.greatest(F.lit(0), F.col(n) - alone)), lambda x, i: F.struct(x["e"].alias("e"), (F.size("s") - i).alias("left")))
    met = split.df.join(shared, ["leader", "rep"]).withColumn("own", F.struct("rep", "c", "apart", "bound", "slack"))
    few = met.select("leader", "own", F.explode(rare("few")).alias("at"))
    many = met.where("apart").select("leader", F.col("own").alias("x"), F.explode(rare("many")).alias("at"))
    at = lambda rows, side: rows.select("leader", F.col("at.e").alias("e"), F.col("at.left").alias(f"{side}_left"), side)
    x, y = at(few.withColumnRenamed("own", "x").where("x.apart"), "x"), at(few.withColumnRenamed("own", "y"), "y")
    # What both differ in alike has to make up for all differences. Where they meet on the rarest of it, all of it lies
    # from there on in either order, so it's at most what either has left; pairs that meet too late are no candidates.
    enough = f"x.c <> y.c and least(x_left, y_left) * {num + DEN} >= x.bound + y.bound - x.slack"
    both = x.join(y.where("y.apart"), ["leader", "e"]).where(f"x.rep < y.rep and {enough}")
    mixed = at(many, "x").join(y.where("not y.apart"), ["leader", "e"]).where(enough)
    return _ordered(both.unionByName(mixed).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))


def stays(top: int):
    """Whether a row of classes() over numbered rows stays: the smallest id of its component does, and all rows of one without ids."""
    return (F.col("id") == F.col("component_id")) | (F.col("component_id") > top)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    docs, names = whole_ids(docs)
    rows, vertex, top = numbered(docs)
    known = lambda c: F.when(F.col(c) <= top, F.col(c)).cast(docs.schema["doc_id"].dataType)
    found = classes(rows, vertex).select(known("id").alias("doc_id"), "n_shingles", known("component_id").alias("component_id"), stays(top).alias("kept"))
    return named(found, names, "doc_id", "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay at STAGE_NUM/DEN, those without an id judged each for itself."""
    own = docs.columns
    key = free_name(docs, "key")
    docs, _ = whole_ids(docs.withColumn(key, F.col("doc_id")), key)
    rows, vertex, top = numbered(docs, key)
    keep = classes(rows, vertex, num=STAGE_NUM, n_bands=STAGE_BANDS).where(stays(top)).select(F.col("id").alias(vertex)).distinct()
    return rows.join(keep, vertex, "left_semi").select(*(F.col(f"`{c}`") for c in own))

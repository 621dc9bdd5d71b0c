"""Every operator and stage on awkward tables: clashing names, no rows, repeats and ties; models and stages written out plainly."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, html, language, media, minhash, pii, substring, suffix_dedup, toxicity

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
CLASHES = "id digest n chunk data bucket hit key more found base all email vertex number name score h rep band text_ __hit __m __l __base __spans __more __keep __vertex __y __key copy sha".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def some_docs():
    base = prose(60)
    texts = [base, base, base + " end", prose(30) + " mail a@b.example.com and 10.1.2.3", None, "", "  ", "idiot scum " + prose(20), 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"', "x" * 3000, prose(2000)]
    return [(i, t, "en" if i % 2 else "de", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, base, None, None, None), (3, texts[3], "de", "s0", 4)]


ROWS = some_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def crowded(docs):
    """The same rows with columns of names that operators might use themselves."""
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(12)), (2, ROWS[0][1])], "item_id int, text string")


MACHINE = toxicity.Machine(np.array(sorted(toxicity.terms("idiot scum"))), -2.0, np.linspace(0.5, 1.5, len(toxicity.terms("idiot scum"))), np.ones((len(toxicity.terms("idiot scum")), toxicity.FACTORS)) * 0.2)
NET = language.Network.fresh(["de", "en"])
WEIGHTS = [-1.0, *[0.4] * pii.N_FLAGS]

OPERATORS = {
    "op1": lambda d, b: suffix_dedup.digest(d),
    "op2": lambda d, b: decontaminate.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "op3": lambda d, b: substring.digest(d),
    "op4": lambda d, b: pii.digest(d, WEIGHTS),
    "op4_redact": lambda d, b: pii.redact(d, WEIGHTS).select("doc_id", "text"),
    "op5": lambda d, b: d.select("doc_id", html.extract(F.col("text")).alias("out")),
    "op6": lambda d, b: minhash.digest(d),
    "op6_stage": lambda d, b: minhash.without_near_copies(d).select("doc_id", "text"),
    "op7": lambda d, b: media.digest(d).select("doc_id", *media.COLUMNS),
    "op8": lambda d, b: toxicity.score(d, MACHINE).select("doc_id", "score", "predicted"),
    "op9": lambda d, b: bpe.digest(d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
    "op10": lambda d, b: language.identify(d, NET).select("doc_id", "lang_pred", "score"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashes_empties_and_repeats(name, spark, docs, crowded, bench):
    run = OPERATORS[name]
    rows = lambda df: sorted(map(str, df.collect()))
    plain = rows(run(docs, bench))
    assert rows(run(crowded, bench)) == plain
    empty = spark.createDataFrame([], crowded.schema)
    assert run(empty, bench).count() == 0
    if name != "op6_stage":
        assert len(plain) == len(ROWS)
        assert sum("doc_id=3," in r for r in plain) == 2 and len({r for r in plain if "doc_id=3," in r}) == 1  # a repeated row, the same result


def test_columns_stay(crowded, bench):
    """What operators add columns to keeps its own."""
    for made in (decontaminate.contamination(crowded, bench), media.digest(crowded), bpe.digest(crowded), pii.redact(crowded, WEIGHTS), minhash.without_near_copies(crowded)):
        assert made.agg(*(F.min(f"`{c}`").alias(c) for c in CLASHES)).first().asDict() == {c: f"own {c}" for c in CLASHES}


def test_models_of_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(none, labels)
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none)).collect()} == {"und"}
    assert pii.digest(docs, pii.train(none)).count() == len(ROWS)


def test_op5_density_written_out():
    """Densities and their sums against the definition, by recursion, on pages with and without an article; ties go to the first."""
    pages = [
        "<body><div class=menu><a href=x>l</a></div><div><h2>Title</h2>" + "<p>Some words that say a lot of things.</p>" * 5 + "</div><ul>" + "<li><a href=x>link one</a></li>" * 9 + "</ul></body>",
        "<body><article><h1>T</h1>" + "<p>One <b>two</b> three <a href=x>four</a>.</p>" * 3 + "</article><div><p>other words</p></div></body>",
        "<body>" + "<div><p>equal parts</p><p>equal parts</p></div>" * 2 + "</body>",
        "<p>no body at all",
    ]
    for page in pages:
        root = html.parse(page)
        nodes = html.ordered(root)
        body = next((x for x in nodes if x.tag == "body"), root)
        html.spare(nodes, body)
        html.measure(nodes, body)

        def size(x, link=False):
            """(characters, link characters, tags, link tags) below a node"""
            total = [0, 0, 0, 0]
            for c in x.children:
                if isinstance(c, str):
                    n = len(re.sub(r"\s+", " ", c).strip())
                    total[0] += n
                    total[1] += n * link
                elif not c.drop:
                    own = size(c, link or c.tag == "a")
                    total = [a + b for a, b in zip(total, own)]
                    total[2] += 1
                    total[3] += c.tag == "a"
            return total

        whole, whole_links, _, _ = size(body)

        def density(x):
            c, lc, t, lt = size(x, x.tag == "a")
            if not c or x.drop:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + whole_links / max(whole, 1) * c + math.e)
            top = math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1e-9) / math.log(base) if base > 1.0000001 and math.log(base) > 1e-6 else math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + math.e)
            return max(0.0, c / max(t, 1) * top)

        def blocks_below(x):
            for c in x.children:
                if not isinstance(c, str) and not c.drop:
                    yield from [c] if c.tag in html.BLOCK else blocks_below(c)

        for node in nodes:
            if not node.drop:
                assert node.density == pytest.approx(density(node)), (node.tag, page)
                assert node.total == pytest.approx(sum(map(density, blocks_below(node))))
        best = max((x for x in nodes if not x.drop), key=lambda x: x.total)  # max takes the first among equals
        chosen = html.select(root)
        assert best in chosen or chosen == [body]
    assert html.extract_text(pages[0]) == "Title " + " ".join(["Some words that say a lot of things."] * 5)
    assert html.extract_text(pages[1]).startswith("T One two three four.")


def test_op8_written_out(spark):
    """The score against the sum over pairs; the fitted machine against its labels, copies counted once."""
    rows = [np.array(sorted(toxicity.terms(f"{prose(30)} {'awful thing' if k % 5 == 0 else ''}")), np.int64) for k in range(200)]
    y = np.array([float(k % 5 == 0) for k in range(200)])
    model = toxicity.fit(rows + rows[1:2] * 50, np.append(y, np.zeros(50)))
    assert np.array_equal(model.weights, toxicity.fit(rows, y).weights)  # fifty copies change nothing
    text = "an awful thing to say " + prose(10)
    known = sorted(k for k, b in enumerate(model.buckets) if int(b) in toxicity.terms(text))
    z = model.bias + sum(model.weights[k] for k in known) + sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(known) for b in known[i + 1 :])
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert known and got["score"] == pytest.approx(1 / (1 + math.exp(-z))) and got["predicted"] == 1


def test_op8_held_out(spark, data):
    """Toxic rows that were never learned from are caught, clean ones left alone."""
    from lodestone.llm.queries import op8_toxicity

    larger = data.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = [(truth[r["doc_id"]], r["predicted"]) for r in op8_toxicity(spark, larger).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(p for t, p in got if t) >= 0.6 * sum(t for t, _ in got) > 0
    assert sum(p for t, p in got if not t) <= 0.05 * len(got)


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def test_stages_written_out(spark):
    """Each stage of the pipeline, row by row, on what the stage before it kept."""
    from tokenizers import Tokenizer

    base, leak = prose(80).split(), prose(30)
    rows = []
    for k in range(30):
        words = list(base) if k % 4 == 0 else prose(50).split()
        if k % 8 == 4:
            words[k % 70] = "changed"
        rows.append(" ".join(words) + (f" call +49 30 1234567{k} x{k}@y.example.org" if k % 5 == 0 else "") + (" " + leak[:200] if k % 11 == 7 else ""))
    rows += ["", None, leak, rows[3]]
    table = [(k, t, "en", "s", 7) for k, t in enumerate(rows)]
    docs = spark.createDataFrame(table, DOCS).repartition(2)

    # 6: the smallest id of each component of texts with 100 x intersection >= 80 x union
    own = {k: sets(t) for k, t, *_ in table}
    top = {k: k for k in own}
    for _ in own:
        for a in own:
            for b in own:
                if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                    top[a] = top[b] = min(top[a], top[b])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    due = [r for r in table if top[r[0]] == r[0]]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(due, key=str) and kept.columns == docs.columns

    # 2: no window of ten item words occurs
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = low(leak)
    windows = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    clean = [r for r in due if not any(tuple(low(r[1])[k : k + 10]) in windows for k in range(len(low(r[1])) - 9))]
    found = decontaminate.contamination(kept, spark.createDataFrame([(1, leak)], "item_id int, text string"))
    assert sorted(r["doc_id"] for r in found.where("not contaminated").collect()) == [r[0] for r in clean] and len(clean) < len(due)

    # 4: spans are cut out of the text as the operator lists them
    rest = spark.createDataFrame(clean, DOCS)
    weights = pii.train(rest)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(rest, weights).collect()}
    done = corpus_pipeline.redact_personal_data(spark, rest, "").collect()
    for r in done:
        text, at, out = rows[r["doc_id"]], 0, ""
        for kind, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        assert r["text"] == (None if text is None else out + text[at:]) and r["n_chars"] == len(r["text"] or "")

    # 9: ids as the library's
    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in done}
    last = corpus_pipeline.tokenize(spark, spark.createDataFrame([tuple(r) for r in done], DOCS), "").collect()
    assert len(last) == len(done)
    for r in last:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["lossless"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id int, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_op7_media_columns(spark, docs):
    """Stored forms, their digests, sniffed types and carved values."""
    import zlib

    texts = {i: t for i, t, *_ in ROWS}
    for r in media.digest(docs).collect():
        payload = media.pad((texts[r["doc_id"]] or "").encode())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and r["media_bytes"] == 44 + len(payload)
    blob = b"noise" + media.wav(b"ab" * 32) + b"GIF89a"
    rows = [(1, bytearray(media.wav(b"x" * 64)), "png"), (2, bytearray(blob), "wav"), (3, None, None), (4, bytearray(b""), "gif")]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k int, data binary, declared string").select("k", media.inspect(F.col("data"), F.col("declared")).alias("m")).collect()}
    assert (got[1]["kind"], got[1]["corrected"]) == ("wav", True) and (got[2]["kind"], [tuple(c) for c in got[2]["carved"]]) == ("unknown", [("wav", 5, 5 + 44 + 64)])
    assert got[3]["kind"] == "unknown" and not got[3]["corrected"] and got[4]["kind"] == "unknown"
    stored = docs.select("doc_id", media.media_column(F.col("text")).alias("m")).where("doc_id = 0").first()["m"]
    assert media.samples(bytes(stored)) == media.pad(ROWS[0][1].encode())

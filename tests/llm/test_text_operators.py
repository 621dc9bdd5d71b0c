"""Operators against brute force, round trips and the tokenizer library, on small tables with awkward rows."""

import hashlib
import random
import re

import pytest

from lodestone.llm import bpe, decontaminate, exchange, gsaca, html, language, media, minhash, pii, substring, suffix_dedup, toxicity

random.seed(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, repeats within a text, nulls, empties, long and tiny texts."""
    shared, rows = prose(40), []
    for _ in range(12):
        base = prose(90)
        rows += [base, base, base.replace("w1", "x1", 1), prose(20) + " " + shared + " " + prose(15)]
    long_ = prose(3000)
    rows += [None, "", "   ", "one two", "one two", "ÀÉ straße " * 40, long_, long_[:9000], shared, "a" * 700, "ab" * 300 + prose(30)]
    random.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_suffix_arrays():
    strings = [[random.randint(1, k) for _ in range(random.randint(0, 30))] for k in (1, 2, 4, 200) for _ in range(60)]
    import numpy as np

    for s, got in zip(strings, gsaca.suffix_arrays([np.array(s, np.int64) for s in strings])):
        assert list(got) == sorted(range(len(s)), key=lambda i: s[i:])
    assert gsaca.suffix_arrays([]) == []


def removed_bytes(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        c = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                c[k : k + 100] = b"\1" * 100
            else:
                seen.add(b[k : k + 100])
        out[i] = (len(b), sum(c), hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest(), len(re.findall(b"\1+", bytes(c))))
    return out


def check_op1(found, rows):
    assert {i: (r["n_bytes"], r["n_removed"], r["kept_sha256"], r["n_spans"]) for i, r in by_id(found).items()} == removed_bytes(rows)


@pytest.mark.parametrize("chunk", [4_000_000, 3_000])
def test_op1(docs, rows, empty, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    check_op1(suffix_dedup.digest(docs), rows)
    assert suffix_dedup.digest(empty).count() == 0


@pytest.mark.parametrize("hot", [0, 2])
def test_op1_hot_anchors(docs, rows, hot, monkeypatch):
    """Anchors whose pieces stay in their chunks, with merges by string: the same rows."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(exchange, "HOT", hot)
    check_op1(suffix_dedup.digest(docs), rows)


def test_op1_pieces_are_merged():
    """Many segments of one anchor, in pieces and shares, leave each distinct string once, and its smallest place."""
    import numpy as np

    base = bytes(random.randrange(97, 120) for _ in range(130))
    segments = sorted({base[:110] + bytes([random.randrange(97, 100) for _ in range(random.randrange(1, 20))]) for _ in range(60)})
    homes = np.array([(random.randrange(9), 0, 1000 * k, k % 3) for k in range(len(segments))], np.int64)
    best, total = {}, 0
    for s, (d, n, p, c) in zip(segments, homes.tolist()):
        for k in range(len(s) - 99):
            total += 1
            best[s[k : k + 100]] = min(best.get(s[k : k + 100], (99,)), (d, n, p + k, c))
    for piece, share in ((100_000, 200_000), (400, 200_000), (400, 9)):
        suffix_dedup.PIECE, suffix_dedup.SHARE, before = piece, share, (suffix_dedup.PIECE, suffix_dedup.SHARE)
        try:
            group = suffix_dedup.Group(segments, homes)
            (at,), gone = suffix_dedup.settled([group])
        finally:
            suffix_dedup.PIECE, suffix_dedup.SHARE = before
        assert {x.tobytes(): tuple(w) for x, w in zip(group.strings(at), group.where(at).tolist())} == best
        assert len(at) == len(best) and len(gone) == total - len(best)


def removed_words(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = [0] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                c[k : k + 20] = [1] * 20
            else:
                seen.add(g)
        out[i] = (len(w), sum(c), hashlib.sha256(" ".join(x for x, y in zip(w, c) if not y).encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [500_000, 400])
def test_op3(docs, rows, empty, chunk, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    got = by_id(substring.digest(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == removed_words(rows)
    assert substring.digest(empty).count() == 0


def test_op2(spark, docs, rows, empty):
    texts = dict(rows)
    source = next(t for t in texts.values() if t and len(t.split()) > 60)
    items = [(1, " ".join(source.split()[5:30]).upper()), (2, "one two"), (3, None), (4, "!!"), (10, "one two"), (5, prose(30))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = low(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    for blocks in (8 << 20, 1):
        decontaminate.BLOCK_CHARS, before = blocks, decontaminate.BLOCK_CHARS
        got = by_id(decontaminate.contamination(docs, bench))
        decontaminate.BLOCK_CHARS = before
        for i, t in rows:
            w, hit, own = low(t), [0] * len(low(t)), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if f := windows.get(tuple(w[k : k + n])):
                        own |= f
                        hit[k : k + n] = [1] * n
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), sum(hit), len(own), sum(hit) > 0)
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_op2_blocks_tell_rows_apart(spark, monkeypatch):
    """Hits of later blocks reach rows without an id, and no other text of the same id."""
    a, b, clean = prose(30), prose(30), prose(30)
    rows = [(None, a), (None, b), (None, b), (7, b), (7, clean), (7, a + " " + b), (None, None), (8, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, a), (2, b), (3, b)], "item_id int, text string").coalesce(1)
    counts = {a: (30, 1), b: (30, 2), a + " " + b: (60, 3), clean: (0, 0), None: (0, 0)}
    for blocks in (8 << 20, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", blocks)
        got = [((r["doc_id"], r["text"]), r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()]
        assert sorted(got, key=str) == sorted((((i, t), *counts[t], counts[t][0] > 0) for i, t in rows), key=str)


def test_op4(spark, empty):
    texts = [
        "mail a.b@c.example.com_x@d.ef or a@b.c..d@e.f", "ip 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 0255.01.002.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 378282246310005", "call +1 (583) 555-6359 or +12 or +1 2 3 4 5 6 7 8 9",
        "password=f0b4e711f4353f8e01 ssn 123-45-6789", "Ünïcode 🙂 x@y.zz 10.0.0.1", None, "", "9" * 5000, "1 " * 3000, "a" * 5000 + "@", "x@" + "a." * 3000 + "a",
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    weights = pii.train(df)
    got = by_id(pii.digest(df, weights))
    for i, t in rows:
        spans = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns) for m in re.finditer(p, t or "") if good(k, m.group()))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k, _ in patterns] == [sum(s[2] == k for s in spans) for k, _ in patterns]
    assert "secret" in got[4]["spans"]
    clean = by_id(pii.redact(df, weights))
    assert clean[5]["text"] == "Ünïcode 🙂 [email] [ip]" and clean[6]["text"] is None
    assert pii.digest(empty, pii.train(empty)).count() == 0


PAGE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><!-- c --><div class=\"ad\">Buy</div><article><h1>T &amp; U</h1><p><b>Head<br><p>One  two\nthree.</p><p>Four <b>fi</b>ve.</p></article><footer>&copy; x</footer></body></html>"


def test_op5(spark):
    assert html.extract_text(PAGE) == "T & U Head One two three. Four five."
    assert html.extract_text(None) == "" and html.extract_text("") == "" and html.extract_text("plain &lt;text") == "plain <text"
    assert html.extract_text(PAGE[: PAGE.index("ve.</p>")]) == "T & U Head One two three. Four fi"
    parts = "<body><div class=menu>" + "<a href=x>link words here</a>" * 9 + "</div><div id=main><div><p>" + "</p><p>".join(["A long paragraph of words that says a lot."] * 6) + "</p></div></div><div class='comments'><p>first comment</p></div></body>"
    assert html.extract_text(parts) == " ".join(["A long paragraph of words that says a lot."] * 6)
    html.extract_text("<div" * 3000 + "<p>" * 3000 + "<a <b \"" * 2000)  # hostile, but ends


def test_op5_wrappers():
    """Layout classes and forms around the content don't take it along; boilerplate beside it still goes."""
    said = ["A long paragraph of words that says a lot."] * 6
    text, ps = " ".join(said), "<p>" + "</p><p>".join(said) + "</p>"
    for name in ("content no-sidebar", "has-sidebar", "overflow-hidden", "with-comments", "sidebar", "content widget"):
        for inner in (ps, f"<article>{ps}</article>", f"<main>{ps}</main>"):
            assert html.extract_text(f"<body><div class='{name}'>{inner}</div><div class='ad'><p>Buy it now</p></div></body>") == text, (name, inner)
        assert html.extract_text(f"<body><article><div class='x-{name}'>{ps}</div><div class='comments'><p>first</p></div></article></body>") == text
    assert html.extract_text(f"<body><form action=x><nav><a href=x>Home</a></nav><div id=c>{ps}</div><footer>f</footer></form></body>") == text
    assert html.extract_text(f"<body><article>{ps}</article><div class='comments'><article><p>{text} {text}</p></article></div><form><p>{text} {text}</p></form></body>") == text
    assert html.extract_text(f"<body><div hidden><main>{text}</main></div><article>{ps}</article></body>") == text


def brute_components(rows):
    known = minhash.WordHash()
    sets = {i: set(minhash.shingles(known, t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op6(spark, empty):
    rows = []
    for _ in range(4):
        base = prose(120).split()
        for _ in range(12):
            t = list(base)
            for _ in range(random.choice([0, 1, 2, 3, 4])):
                t[random.randrange(len(t))] = random.choice(VOCAB)
            t = t[: len(t) - random.choice([0, 0, 5, 20, 22])]
            rows.append(" ".join(t))
            if random.random() < 0.3:
                t[3] = "zz"
                rows.append(" ".join(t))
    random.shuffle(rows)
    rows = list(enumerate([*rows, rows[0], None, "", "a b", "A b", "a c"]))
    got = by_id(minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert minhash.digest(empty).count() == 0


def test_op7(docs, rows, empty):
    got = by_id(media.digest(docs))
    for i, t in rows:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
    blob = b"BM??" + media.wav(b"ab" * 32) + b"RIFF" + b"GIF89a"
    assert media.carve(blob) == [("wav", 4, 4 + 44 + 64)] and media.sniff(media.wav(b""), "png") == ("wav", True) and media.sniff(None) == ("unknown", False)
    assert media.digest(empty).count() == 0


def test_op9(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    odd = ["x<|endoftext|> y", " \x1c\x85　a  b\n\n", "日本🙂é²Ⅷ٣'ll", "a" * 3000, "!!!???---"]
    codec = bpe.Codec(bpe.default_path())
    for t in odd:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = by_id(bpe.digest(docs))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest(empty).count() == 0


def test_op8(spark):
    import numpy as np

    vocab = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    prose = lambda n: " ".join(random.choice(vocab) for _ in range(n))  # noqa: E731  words of letters only
    good, bad = [prose(60) for _ in range(300)], [prose(30) + " awful group " + prose(30) + " nasty" for _ in range(60)]
    rows = [np.array(sorted(toxicity.terms(t)), np.int64) for t in good + bad]
    model = toxicity.fit(rows, np.array([0.0] * 300 + [1.0] * 60))
    df = spark.createDataFrame([(0, prose(60)), (1, prose(50) + " awful group nasty"), (2, None), (3, "")], "doc_id long, text string")
    got = by_id(toxicity.score(df, model))
    assert [got[i]["predicted"] for i in range(4)] == [0, 1, 0, 0] and all(0 <= r["score"] <= 1 for r in got.values())
    constant = toxicity.fit([], np.array([]))
    assert by_id(toxicity.score(df, constant))[1]["predicted"] == 0


def test_op10(spark):
    a, b = ["the", "with", "thing", "other", "then"], ["der", "und", "nicht", "schön", "über"]
    make = lambda words: " ".join(random.choice(words) + random.choice(words) for _ in range(40))
    net = language.fit([make(a) for _ in range(60)] + [make(b) for _ in range(60)], ["en"] * 60 + ["de"] * 60)
    df = spark.createDataFrame([(0, make(a)), (1, make(b)), (2, None), (3, "123 !!"), (4, make(a) * 50)], "doc_id long, text string")
    got = by_id(language.identify(df, net))
    assert [got[i]["lang_pred"] for i in range(5)] == ["en", "de", "und", "und", "en"]
    text = make(a) + " 12,3 " + make(b) + " Ü" * 300
    assert language.pooled(net, ["", text])[1][1] == pytest.approx(plain_probabilities(net, text).max(), abs=1e-4)


def plain_probabilities(net, text):
    """The network written out: every window of a text, byte by byte, both ways, pooled over the window's own positions."""
    import numpy as np

    def states(data, d, size=language.HIDDEN):
        out, h = [], np.zeros(size)
        for byte in data if d == 0 else data[::-1]:
            x, r = net.x[d][byte].astype(float), h @ net.h[d].astype(float)
            z, g = (1 / (1 + np.exp(-(x + r)[k * size : (k + 1) * size])) for k in (0, 1))
            c = np.tanh(x[2 * size :] + g * r[2 * size :])
            h = (1 - z) * c + z * h
            out.append(h)
        return np.array(out if d == 0 else out[::-1])

    data, found = text.lower().encode(), []
    for at in range(0, len(data), language.BLOCK):
        low = max(0, at - language.MARGIN)
        window = data[low : at + language.BLOCK + language.MARGIN]
        e = np.exp(np.hstack([states(window, 0), states(window, 1)]) @ net.out + net.bias)
        found.append((e / e.sum(axis=1, keepdims=True))[at - low : at - low + language.BLOCK])
    p = np.concatenate(found)
    assert len(p) == len(data)
    return p.mean(axis=0)


def test_op10_gradients():
    """Backpropagation against differences of the loss."""
    import numpy as np

    net = language.Network.fresh(["a", "b", "c"])
    rows = [w for t in (b"some words here", b"andere", b"x") for w in language.windows(t, 6)]
    y = np.arange(len(rows)) % 3

    def loss(n):
        order = sorted(range(len(rows)), key=lambda k: -len(rows[k][0]))
        data, size, mask = language.pack([rows[k] for k in order])
        p = n.probabilities(data, size)
        return float(-(np.log(p[:, np.arange(data.shape[1]), y[order]]) * mask).sum() / mask.sum())

    seen = [np.zeros_like(v) for v in (*net.x, *net.h, net.out, net.bias)]
    moments = [(np.zeros_like(v), s) for v, s in zip((*net.x, *net.h, net.out, net.bias), seen)]
    before = [v.copy() for v in (*net.x, *net.h, net.out, net.bias)]
    net.step(rows, y, moments, 1)
    for value, old in zip((*net.x, *net.h, net.out, net.bias), before):
        value[...] = old
    for (first, _), value in zip(moments, (*net.x, *net.h, net.out, net.bias)):
        grad = first / 0.1
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old, low, high = value[at], None, None
        value[at] = old + 2e-2
        high = loss(net)
        value[at] = old - 2e-2
        low = loss(net)
        value[at] = old
        assert grad[at] == pytest.approx((high - low) / 4e-2, rel=0.05, abs=2e-4)


def test_op10_held_out(spark, data):
    """Languages of rows that were never learned from."""
    from lodestone.llm.queries import op10_language

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = [r for r in op10_language(spark, data).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.93 * len(got) > 0


def test_null_ids_and_repeats(spark):
    text = prose(60)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, prose(50))], "doc_id long, text string")
    for found in (suffix_dedup.digest(df), substring.digest(df), minhash.digest(df), bpe.digest(df)):
        assert found.count() == 5


@pytest.mark.parametrize("chunk", [500_000, 400])
def test_texts_of_one_id(spark, chunk, monkeypatch):
    """Different texts without an id, or of one id, are searched and cut each for itself."""
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk * 6)
    shared, copy = prose(40), prose(60)
    for ids in ((None, None, None, None), (9, 9, 9, 9)):
        texts = [copy, prose(25) + " " + shared + " " + prose(5), prose(90), shared + " " + prose(45)]
        for some in (texts, texts[1:]):
            rows = [(1, copy), (2, prose(10) + " " + shared), *zip(ids, some), *zip(ids, some[:2])]
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
            order = sorted({(2**63 - 1 if i is None else i, t) for i, t in rows})
            for module, brute, n in ((suffix_dedup, removed_bytes, "n_bytes"), (substring, removed_words, "n_words")):
                due = brute(list(enumerate(t for _, t in order)))  # ids in the order of (id, text)
                want = sorted(str((i, *due[order.index((2**63 - 1 if i is None else i, t))][:3])) for i, t in rows)
                assert sorted(str((r["doc_id"], r[n], r["n_removed"], r["kept_sha256"])) for r in module.digest(df).collect()) == want


def test_near_copies_without_id(spark):
    """Rows without an id go if they're near copies of a row with one, and are compared even if their text has no id at all."""
    import corpus_pipeline

    base, other, third = prose(120).split(), prose(120), prose(60).split()
    near = " ".join([*base[:-1], "zz"])
    end = " ".join([*third[:-1], "zz"])
    rows = [(4, " ".join(base)), (None, " ".join(base)), (None, near), (None, other), (None, other), (None, None), (None, ""), (6, " ".join(third)), (5, end), (None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted([(4, rows[0][1]), (None, other), (None, other), (None, None), (None, ""), (5, end), (None, "a b"), (7, None)], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()), key=str) == want
    got = minhash.digest(df).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == sorted(["4", "4"] + ["None"] * 5)


def test_threshold_of_the_stage(spark):
    """Two words of 120 changed leave 106 of 126 shingles: a near copy for the pipeline's stage, not for op6."""
    import corpus_pipeline

    base = [f"v{i}" for i in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:40], "x", *base[41:80], "y", *base[81:]])), (3, " ".join([*base[:20], "x", *base[21:50], "y", *base[51:80], "z", *base[81:]])), (4, prose(100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3, 4]
    assert sorted(r["doc_id"] for r in minhash.digest(df).where("kept").collect()) == [1, 2, 3, 4]


def test_pipeline(spark, data):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, data)
    assert got.where("not lossless").count() == 0 and 0 < got.count() < 200


def test_ids_of_text(spark, rows):
    """Ids that are no numbers, in their own order; nulls after all."""
    some = [(f"doc-{i:03}", t) for i, t in rows[:40]]
    base = prose(80)
    some += [("doc-900", base), ("zz", base), (None, base), ("Ä", "x " + base)]
    df = spark.createDataFrame(some, "doc_id string, text string").repartition(2)
    order = sorted((i for i, _ in some if i is not None), key=lambda i: i.encode())
    number = {i: k for k, i in enumerate(order)}
    for module, brute, n in ((suffix_dedup, removed_bytes, "n_bytes"), (substring, removed_words, "n_words")):
        due = brute([(number.get(i, 10**6), t) for i, t in some])
        got = {r["doc_id"]: r for r in module.digest(df).collect()}
        assert {i: (r[n], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: due[number.get(i, 10**6)][:3] for i, _ in some}
    due = brute_components([(number[i], t) for i, t in some if i is not None])
    got = {r["doc_id"]: r for r in minhash.digest(df).collect()}
    assert {i: r["component_id"] for i, r in got.items() if i is not None} == {i: order[due[number[i]][1]] for i in order}
    assert got[None]["component_id"] == "doc-900" and not got[None]["kept"]


def test_members_that_meet_too_late(spark):
    """Variants of one text that change the same places, most to the same few words, share many differences from it, few enough of them to be alike."""
    own = random.Random(7)
    base = [f"v{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(60):
        t = list(base)
        for at in own.sample(range(5, 115, 6), 7):
            t[at] = f"x{own.randrange(2)}"
        rows.append((2 * i + 1, " ".join(t)))
        t[0] = f"y{i}"
        rows.append((2 * i + 2, " ".join(t)))
    known = minhash.WordHash()
    sets = {i: set(minhash.shingles(known, t).tolist()) for i, t in rows}
    alike = {(a, b) for a in sets for b in sets if 0 < a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members = spark.createDataFrame([(0, i, i) for i in sets if i], "leader long, rep long, c long")
    got = {(r["a"], r["b"]) for r in minhash._same_differences(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", members, 80).collect()}
    assert len(alike) >= 60 and alike <= got
    assert 2 * len(got) < len(sets) * (len(sets) - 1) / 2

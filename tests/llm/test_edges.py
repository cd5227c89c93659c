"""Operators against brute force where SQL cannot say what they do, and what each stage and operator does with nulls, empty tables, repeated rows, long texts and clashing columns."""

import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from noteloom.llm import chat, common, components, ctw, decontam, extract, langid, neardup, packing, quality, queries, spotsigs, sufdedup

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, spans int, key string, batch int, near string"
LONG = " ".join(random.Random(3).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=40_000))


def messy():
    r = random.Random(1)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(random.Random(k).choices(vocab, k=120)) + ".\n"
    rows = [(k, text(k)) for k in range(40)] + [(100, text(5)), (101, text(5)), (7, text(7)), (7, text(7))]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "é😀ß " * 80), (205, LONG), (None, text(8)), (None, None), (206, text(9)[:400] + text(300))]
    return [(i, t, None if k % 5 == 0 else "en", "s", 1, "r", 2, "k", 3, "n") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), KINDS).repartition(4).persist()


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, docs, name):
    out = stage(name)(spark, docs.limit(0), SF)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS


def test_stage_quality(spark, docs):
    out = stage("quality classifier")(spark, docs, SF)
    assert out.columns == corpus_pipeline.COLUMNS and out.count() <= docs.count()
    scored = quality.score(docs, quality.train(docs, common.table(spark, SF, "labels")), keep=["doc_id", "key"])
    assert scored.columns == ["doc_id", "key", "score"] and scored.count() == docs.count() and scored.filter("score < 0 or score > 1 or score is null").count() == 0
    # Without labels nothing is known, and all rows stay.
    blank = quality.train(docs, common.table(spark, SF, "labels").limit(0))
    assert quality.score(docs, blank).filter("score = 0.5").count() == docs.count()


def test_stage_neardup(spark, docs):
    out = stage("MinHash near-dedup")(spark, docs, SF)
    left = [r.doc_id for r in out.collect()]
    assert out.columns == corpus_pipeline.COLUMNS
    assert 5 in left and 100 not in left and 101 not in left and left.count(7) == 3 and left.count(None) == 2
    assert {200, 201, 202, 203, 204, 205, 206} <= set(left)


def test_stage_suffix(spark, docs):
    out = stage("suffix-array dedup")(spark, docs, SF)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    want = {k: t for k, t, *_ in messy()}
    assert got[200] == [None] and got[201] == [""] and got[202] == [" \n\t"] and got[203] == ["one"]
    assert got[5] == [want[5]] and not got[100] and not got[101]  # the first copy stays, the others lose all
    assert got[206] and len(got[206][0]) < len(want[206]) and want[206].endswith(got[206][0][-100:])
    assert all(t is None or t.encode().decode() == t for ts in got.values() for t in ts)


def test_stage_decontamination(spark, docs):
    item = common.table(spark, SF, "benchmark").first().text
    hit = spark.createDataFrame([(900, f"before {item} after", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage("benchmark decontamination")(spark, docs.select(*corpus_pipeline.COLUMNS).unionByName(hit), SF)
    left = [r.doc_id for r in out.collect()]
    assert out.columns == corpus_pipeline.COLUMNS and 900 not in left and len(left) == docs.count()


def test_stage_packing(spark, docs):
    out = stage("packing")(spark, docs, SF).collect()
    held = defaultdict(int)
    for r in out:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and len({r.doc_id for r in out}) == len({i for i, *_ in messy()})


def test_run_is_its_stages(spark):
    docs = common.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id", "start").agg(F.sum("length").alias("n"))
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {(r.doc_id, r.n) for r in got.collect()} == {(r.doc_id, r.n) for r in want.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}


# ---------------------------------------------------------------- empty tables


def test_operators_of_nothing(spark, docs):
    none = docs.limit(0)
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert chat.format_trees(chat.chains(turns)).count() == 0
    assert neardup.near_duplicates(none, neardup.Rule())[0].count() == 0
    assert decontam.contamination(none, bench, window=13, share=20).count() == 0
    assert decontam.contamination(docs, bench, window=13, share=20).filter("n_hit > 0").count() == 0
    assert langid.identify(pages, docs).count() == 0 and extract.extract(pages).count() == 0
    assert sufdedup.dedup(none).count() == 0 and packing.pack(none, queries.vocabulary(), tokens=64).count() == 0
    assert spotsigs.near_duplicates(none)[0].count() == 0 and components.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark)).count() == 0
    assert ctw.score(none.select("doc_id", F.lit(True).alias("held_out"), "text")).count() == 0


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda *a: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)


# ---------------------------------------------------------------- quality


def test_moments_are_those_of_all_rows(spark, docs):
    x = quality.features(pa.array([t for _, t, *_ in messy()]))
    got = quality.all_moments(docs.select("text"))
    z = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    want = sum(np.outer(r, r) for r in z)
    assert got[-1, -1] == len(x) and np.allclose(got, want, rtol=1e-5, atol=1e-5)


def test_risk_is_that_of_the_rows():
    """The fit follows the non-negative risk of single rows; here it is written out row by row."""
    r = np.random.default_rng(0)
    p, u, prior = r.normal(1, 1, (60, quality.WIDTH)), np.concatenate([r.normal(1, 1, (80, quality.WIDTH)), r.normal(-1, 1, (120, quality.WIDTH))]), 0.4
    model = quality.fit_nnpu(quality.moments(p), quality.moments(u), prior, steps=30)
    w, b, m, v = np.zeros(quality.WIDTH), 0.0, np.zeros(quality.WIDTH + 1), np.zeros(quality.WIDTH + 1)
    scaled = lambda x: (x - u.mean(0)) / (u.std(0) + 1e-3)
    zp, zu = (np.concatenate([scaled(x), np.ones((len(x), 1))], 1) for x in (p, u))
    w = np.zeros(quality.WIDTH + 1)
    for t in range(1, 31):
        fp, fu = zp @ w, zu @ w
        negative = np.mean((1 + fu) ** 2) / 4 - prior * np.mean((1 + fp) ** 2) / 4
        minus = (zu * (1 + fu)[:, None]).mean(0) / 2 - prior * (zp * (1 + fp)[:, None]).mean(0) / 2
        g = (prior * (zp * (fp - 1)[:, None]).mean(0) / 2 + minus if negative >= 0 else -minus) + 1e-2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model.weights, w[:-1], atol=1e-6) and abs(model.bias - w[-1]) < 1e-6
    assert (model.raw(np.ones((1, quality.WIDTH))) > model.raw(-np.ones((1, quality.WIDTH)))).all()


# ---------------------------------------------------------------- language


def brute_language(pages, docs, temper=0.3, host_weight=4.0, domain_weight=8.0):
    def bucket(a, b, c):
        fold = lambda x: 32 if x < 64 else x + 32 if 65 <= x <= 90 else x
        return ((fold(a) << 16 | fold(b) << 8 | fold(c)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 49

    langs = sorted({lang for lang, t in docs if lang and t is not None})
    n = {k: defaultdict(lambda: 0.5) for k in langs}
    for lang, t in docs:
        for x in zip(*(t.encode()[i:] for i in range(3))) if lang and t else ():
            n[lang][bucket(*x)] += 1
    total = {k: sum(n[k].values()) + 0.5 * ((1 << 15) - len(n[k])) for k in langs}
    soft = lambda logs: [math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs]
    rows = []
    for key, url, html in pages:
        host = (re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", url or "") or ["", ""])[1].lower()
        said = (re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html or "", re.I) or ["", ""])[1].lower()
        data = langid.TAGS.sub(b" ", (html or "").encode())
        log = [temper * sum(math.log(n[k][bucket(*x)] / total[k]) for x in zip(*(data[i:] for i in range(3)))) for k in langs]
        rows.append({"key": key, "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "said": said, "log": log, "p": soft(log)})
    L = range(len(langs))
    whole = [sum(r["p"][i] for r in rows) for i in L]
    prior = [(whole[i] + 1) / (sum(whole) + len(langs)) for i in L]
    out = {}
    for r in rows:
        d = [max(0.0, sum(q["p"][i] for q in rows if q["domain"] == r["domain"]) - r["p"][i]) if r["host"] else 0.0 for i in L]
        h = [max(0.0, sum(q["p"][i] for q in rows if q["host"] == r["host"]) - r["p"][i]) if r["host"] else 0.0 for i in L]
        dp = [(d[i] + domain_weight * prior[i]) / (sum(d) + domain_weight) for i in L]
        logs = [r["log"][i] + math.log((h[i] + host_weight * dp[i]) / (sum(h) + host_weight)) for i in L]
        for field in ("said", "suffix"):
            if r[field]:
                logs = [logs[i] + math.log((sum(q["p"][i] for q in rows if q[field] == r[field]) + 0.5) / (whole[i] + 2)) for i in L]
        p = soft(logs)
        out[r["key"]] = langs[p.index(max(p))], max(p)
    return out


def test_language_brute_force(spark):
    r = random.Random(4)
    make = lambda words, k: " ".join(r.choices(words.split(), k=k))
    words = {"en": "the and of that with this have from they been", "fr": "les des une pour dans avec sur pas plus est", "de": "der die und das ist nicht mit von auf ein"}
    docs = [(k, make(w, 12)) for k, w in words.items() for _ in range(6)] + [(None, "x y z"), ("de", None), ("en", ""), ("fr", "é")]
    pages = [(i, f"http://h{i % 3}.a{i % 2}.{'fr' if i % 4 else 'com'}/", f"<html lang={lang}><p>{make(words[lang], 1 + i % 5)}") for i, lang in enumerate(["en", "fr", "de"] * 5)]
    pages += [(50, None, None), (51, None, "<p>" + make(words["en"], 9)), (52, "http://h0.a0.com/", None), (53, "nonsense", "<<<< & <a"), (54, None, "<p>" + make(words["fr"], 9)), (55, None, "<p>" + make(words["fr"], 9))]
    table = spark.createDataFrame([(*p, "other") for p in pages], "page_id long, url string, html string, lang string").repartition(3)
    got = {x.page_id: (x.lang, x.probability) for x in langid.identify(table, spark.createDataFrame(docs, "lang string, text string").repartition(2)).collect()}
    want = brute_language(pages, docs)
    assert set(got) == set(want)
    for key, (lang, p) in want.items():
        assert got[key][0] == lang and abs(got[key][1] - p) < 1e-4, key
    assert got[50][1] < 0.9  # nothing is known of it but what pages are like


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("reach", [3, 7, 20])
def test_proximity_brute_force(spark, reach):
    r = random.Random(reach)
    texts = [" ".join(r.choices("abcdefgh", weights=[8, 8, 4, 4, 2, 2, 1, 1], k=r.randint(0, 40))) for _ in range(60)] + [None, ""]
    items = [(str(k), " ".join(r.choices("abcdefgh", k=r.randint(1, 5)))) for k in range(25)] + [("none", None), ("other", "zz a")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, near string").repartition(3)
    got = {x.doc_id: x.near for x in decontam.search(docs, spark.createDataFrame(items, "item_id string, text string"), window=13, proximity=reach).collect()}
    for k, t in enumerate(texts):
        w = (t or "").split()
        spans = [set(w[i : i + reach]) for i in range(max(1, len(w) - reach + 1))]
        assert got[k] == sorted(i for i, x in items if x and any(set(x.split()) <= s for s in spans))


# ---------------------------------------------------------------- extraction


def brute_core(root):
    """The node with the largest sum of child densities, every count made anew for each node."""
    nodes = lambda x: [x] + [n for k in x.kids if isinstance(k, extract.Node) and not k.out for n in nodes(k)]
    strings = lambda x: [k for k in x.kids if isinstance(k, str)] + [s for k in x.kids if isinstance(k, extract.Node) and not k.out for s in strings(k)]
    size = lambda s: len(s) - s.count(" ") - s.count("\n")
    chars = lambda x: sum(map(size, strings(x)))
    in_links = lambda x: chars(x) if x.tag == "a" else sum(in_links(k) for k in x.kids if isinstance(k, extract.Node) and not k.out)
    share = in_links(root) / max(1, chars(root))

    def density(x):
        c, lc = chars(x), max(1, in_links(x))
        if not c:
            return 0.0
        below = nodes(x)[1:]
        t, lt = max(1, len(below)), max(1, sum(n.tag == "a" for n in below))
        base = math.log(c / max(1, c - in_links(x)) * lc + share * c + math.e)
        return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)))

    total = lambda x: sum(density(k) for k in x.kids if isinstance(k, extract.Node) and not k.out) + sum(len(k.strip()) for k in x.kids if isinstance(k, str))
    return max(total(x) for x in nodes(root)), {id(x): (density(x), total(x)) for x in nodes(root)}


def test_density_brute_force():
    r = random.Random(9)

    def made(depth):
        tag = r.choice(["div", "section", "ul", "td", "span", "a"])
        inner = "".join(made(depth - 1) if depth and r.random() < 0.6 else r.choice(["<p>" + "word " * r.randint(1, 30) + "</p>", "<a href=x>link</a>", "text ", "<br>"]) for _ in range(r.randint(1, 5)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(40):
        root = extract.tree("<body>" + made(4) + made(3))
        order = extract.measure(root)
        best, each = brute_core(root)
        assert abs(max(x.total for x in order) - best) < 1e-9
        assert all(abs(x.density - each[id(x)][0]) < 1e-9 and abs(x.total - each[id(x)][1]) < 1e-9 for x in order)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='social-security'><p>Pensions are paid monthly to all.</p></div><nav>Home</nav>", "Pensions are paid monthly to all."),
        ("<body><nav><ul><li>Home</li></ul></nav><div class='cookie-banner'>We use cookies</div>", ""),
        ("<body><div class=comments><p>Nice post!</p></div>", ""),
        ("<div class=form-content><p>" + "word " * 80 + "</p></div><div class=nav-links><p>" + "other " * 50 + "</p></div>", " ".join(["word"] * 80)),
        ("<main><p>One &lt;b&gt; &amp; two</p><div class='ad'>Buy</div><p>three</p></main>", "One <b> & two\nthree"),
    ],
)
def test_what_is_left_out(page, want):
    assert extract.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<b><p>", '<a "', "<ul><li>", "<table><tr><td>", "<!--", "<div class=social-security>", "</p>", "<b><table><i></b>"])
def test_extraction_is_linear(piece):
    def took(n):
        start = time.thread_time()
        extract.main_text(piece * n)
        return time.thread_time() - start

    took(1000)
    assert took(32_000) < 0.5 + 14 * took(4_000)


# ---------------------------------------------------------------- fingerprints


def brute_print(text):
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()
    if not words:
        return set()
    common_words, out = set(spotsigs.ANCHORS), set()
    hashed = lambda *parts: int(np.uint64(_chain(parts)).astype(np.int64))
    for i, w in enumerate(words):
        if w in common_words:
            rest = [x for x in words[i + 1 :] if x not in common_words][: spotsigs.CHAIN]
            out.add(hashed(w, " ".join([*rest, *[""] * (spotsigs.CHAIN - len(rest))])))
    return out or {hashed(" " + " ".join(words) + " ")}


def _chain(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=h)
    return h


def test_fingerprints_brute_force(spark):
    r = random.Random(2)
    vocab = "the of a in dog barked house tree Là élan straße x1 and to".split()
    texts = [" ".join(r.choices(vocab, k=r.randint(0, 30))) for _ in range(60)] + ["in the dog barked", "the dog barked", "dog barked", "the", "in the", "", None, "... !!", "THE Dog, barked."]
    rows = spotsigs.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "text", "f").collect()
    for x in rows:
        assert set(x.f) == brute_print(x.text) and x.f == sorted(set(x.f)), x.text
    got = {x.text: set(x.f) for x in rows}
    assert got["the dog barked"] < got["in the dog barked"] and len(got["in the dog barked"]) == 2


def test_near_prints_of_shared_ids(spark):
    w = [" ".join(f"the w{k}{i} and x{k}{i}" for i in range(20)) for k in (0, 1)]
    rows = [(1, w[0]), (1, w[1]), (2, w[0] + " the more"), (3, w[1] + " the more")]
    links, members = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8)
    assert {(r.a, r.b) for r in links.collect()} == {(1, 2), (1, 3)} and members.count() == 4

"""Operators against brute force on small tables, and on nulls, empty and repeated rows, ties, long texts, empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from noteloom.llm import chat, ctw, decontam, extract, langid, neardup, packing, quality, queries, spotsigs, sufdedup

random.seed(5)
VOCAB = ["".join(random.choice("abcdeéß") for _ in range(random.randint(1, 7))) for _ in range(300)] + "the of and der die is la que".split() * 8


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(random.Random(i).randint(5, 220), i) for i in range(60)]
    rows = list(enumerate(base))
    for k in range(25):  # near copies, copies, shared passages
        w = base[k % 8].split()
        for _ in range(k % 4):
            w[random.randrange(len(w))] = random.choice(VOCAB)
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, prose(30, k + 500) + " " + base[1][:420] + " " + prose(9, k + 900)) for k in range(5)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "a"), (304, "abcd" * 300), (305, prose(6000, 77)), (306, base[2]), (306, base[2]), (None, base[3]), (None, None)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in ROWS], "doc_id long, text string, lang string, row_key string, spans long, n int").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_neardup_brute_force(docs):
    rule = neardup.Rule(shingle=3, under=85)
    members, _ = neardup.near_duplicates(docs, rule)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in members.collect()), key=str)
    sets = defaultdict(list)
    for i, t in ROWS:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, t in ROWS for s in [next(s for s in sets[i] if True)] if i is not None), key=str)
    assert [g for g in got if g[0] is not None] == want
    assert sum(g[0] is None for g in got) == 2 and all(g[3] for g in got if g[0] is None)


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup_brute_force(docs, keep_first):
    length = 60
    got = sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, tuple((s.lo, s.hi) for s in r.spans)) for r in sufdedup.dedup(docs, length, 30, keep_first).collect()), key=str)
    rows = [(i, (t or "").encode()) for i, t in ROWS]
    seen = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    first = {}
    for i, b in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], (i, b, k))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if (first[s] != (i, b, k)) if keep_first else seen[s] > 1:
                gone[k : k + length] = b"\1" * length
        spans = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and bool(gone[k - 1]))]
        want.append((i, bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), tuple(zip(spans[::2], spans[1::2]))))
    assert got == sorted(want, key=str)


def test_decontamination_brute_force(docs, spark):
    texts = dict((i, t) for i, t in ROWS if i is not None)
    items = [("a", texts[1][:150]), ("b", texts[5]), ("c", "abcdabcd " + texts[7][:40]), ("d", None), ("e", ""), ("f", texts[303]), (None, texts[2]), ("a", texts[1][:150])]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), window=6).collect()), key=str)
    blocks = sorted(((r.doc_id, r.n_hit) for r in decontam.hits(decontam.search(docs, spark.createDataFrame(items, "item_id string, text string"), window=6, block_bytes=100)).collect()), key=str)

    def cut(t):
        out, now = [], b""
        for b in (t or "").encode().lower() + b" ":
            if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A:
                now += bytes([b])
            elif now:
                out.append(now)
                now = b""
        return out

    want = []
    for i, t in ROWS:
        w, hit, found = cut(t), set(), set()
        for name, s in items:
            q = cut(s)
            for k in range(max(1, len(q) - 5) if q else 0):
                p = q[k : k + 6]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        found |= {name} - {None}
        want.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want, key=str)
    assert blocks == sorted(((w[0], w[2]) for w in want), key=str)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, queries.vocabulary(), tokens=64, segments=5, loss=60).collect()
    tok = Tokenizer.from_file(queries.vocabulary())
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in ROWS)
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        assert sum(r.length for r in s) <= 64 and sum(r.loss_tokens for r in s) <= 60 and len(s) <= 5
    ids = defaultdict(list)
    for r in rows:
        ids[(r.doc_id, r.doc_tokens)].append((r.start, [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]))
    assert sum(len(x) for p in ids.values() for _, x in p) == sum(len(t) * n for (_, t), n in want.items())
    for (i, t), n in want.items():
        if n == 1 and sum(1 for (j, u) in want if j == i and len(u) == len(t)) == 1:
            assert [x for _, p in sorted(ids[(i, len(t))]) for x in p] == list(t)
    assert packing.pack(empty, queries.vocabulary()).count() == 0


def test_full_sequences(docs):
    rows = packing.pack(docs, queries.vocabulary(), tokens=2048).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2048 or r.n & (r.n - 1) == 0 for r in rows)


def test_tokenizer_short_way():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["", None, "DON'T  stop—now 12.5% C'est l'État", "a<|endoftext|>b \x01 é́ İX ΑΣ naïve×÷ {~} ß ÿ Ü", "日本語\ttext\r\nend", "x" * 3000]
    at, ids = packing.WordTokenizer(queries.vocabulary()).encode(pa.array(texts))
    tok = Tokenizer.from_file(queries.vocabulary())
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<|im_start|>assistant\nhi", "<\\|x", "a<\\\\|b", "", None, "<n>\n", "plain é"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", "sy<n>s\nx", None, "assistant", "assistant", "<|r|>", "assistant"], nasty))] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, "assistant", "y")]
    made = chat.format_trees(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree_id: r for r in made.select("tree_id", "formatted", "loss", "leaf", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert len(got[2].turns) == 2 and got[None].turns[0].text == "y"
    spans = sorted((s.lo, s.hi) for s in chat.loss_spans(made).collect() if s.leaf.tree == 1)
    assert [got[1].formatted[a:b] for a, b in spans] == ["<\\|im_start|>assistant\nhi", "", "", "plain é"]


def test_reply_trees(spark):
    rows = [("t", "r", None, "user", "q", 0.0), ("t", "a", "r", "assistant", "one", 1.0), ("t", "b", "r", "assistant", "two", 5.0), ("t", "c", "b", "user", "more", 0.5), ("t", "x", "y", "user", "loop", 9.0), ("t", "y", "x", "user", "loop", 9.0)]
    tree = spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, role string, text string, score double")
    got = {r.leaf: (r["rank"], r.n_turns, r.score) for r in chat.format_trees(tree, keep=2).collect()}
    assert got == {"c": (1, 3, 5.5), "a": (2, 2, 1.0)}
    assert chat.format_trees(tree.limit(0)).count() == 0


def test_spotsigs(docs, empty, spark):
    rows = spotsigs.compare_edited(docs).collect()
    order = sorted(((i if i is not None else 1 << 63, t or "") for i, t in ROWS if i is not None), key=lambda r: r[0])
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    for (i, t), (_, nxt) in zip(order, order[1:]):
        if i != 306 and order[order.index((i, t)) + 1][0] != 306:
            half = len(t) // 2
            assert got[i].edited_text == t[: len(t) - half] + nxt[:half] and got[i].n_chars == len(t)
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[306].fingerprint == got[2].fingerprint and got[300].fingerprint == []
    assert spotsigs.compare_edited(empty).count() == 0
    small = spotsigs.compare_edited(docs.filter("doc_id = 5")).collect()
    assert len(small) == 1 and small[0].near_next == 1.0
    links, members = spotsigs.near_duplicates(docs.filter("doc_id is not null"), 0.6)
    prints = {r.doc_id: set(r.fingerprint) for r in rows if r.doc_id is not None and r.fingerprint}
    reps = {r.class_id for r in members.collect()}
    want = {(a, b) for a in reps for b in reps if a < b and len(prints[a] & prints[b]) >= 0.6 * len(prints[a] | prints[b])}
    assert {(r.a, r.b) for r in links.collect()} == want


def test_many_buckets(docs):
    wide = spotsigs.successors(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), bucket_chars=3000).filter("not _ghost").collect()
    order = sorted({i: t or "" for i, t in ROWS if i is not None}.items())
    nxt = {order[k][0]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    assert {r.doc_id: r.next_text for r in wide} == nxt


def test_ctw_is_a_distribution(spark, docs, empty):
    train = spark.createDataFrame([(1, False, "ab ba ab"), (2, False, "b ab"), (3, True, "ab zz"), (4, True, None)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in ctw.score(train, depth=3).collect()}
    count = Counter("ab ba ab b ab".split()) + Counter({"\n": 2})
    n, v = sum(count.values()), len(count)
    base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ["ab", "zz", "\n"])
    assert abs(got[3].base_score - base) < 1e-9 and (got[3].n_tokens, got[3].n_known, got[3].train_tokens) == (3, 2, n)
    assert (got[4].n_tokens, got[4].n_known) == (1, 1)
    assert got[1].score > got[3].score
    assert ctw.score(empty.select("doc_id", F.lit(False).alias("held_out"), "text")).count() == 0
    assert ctw.score(docs.select("doc_id", (F.col("doc_id") % 3 == 0).alias("held_out"), "text")).count() == len(ROWS)


def test_ctw_context_runs_across_words(spark):
    texts = [(1, False, "ab ba  ab"), (2, False, "b ab a b a"), (3, True, "ab zz b a"), (4, True, "a b zz ab"), (5, True, None), (6, False, "abcdefgh abcdefgh")]
    rows = spark.createDataFrame(texts, "doc_id long, held_out boolean, text string")
    symbols = {}
    for k, _, text in texts:
        s = b"\0" * 5 + b" " + b"".join(w.encode() + b" " for w in (text or "").split()) + b"\n"
        symbols[k] = lambda depth, s=s: [(s[i - depth : i], s[i]) for i in range(6, len(s))]
    for depth in (2, 4, 6):
        got = {r.doc_id: r.score for r in ctw.score(rows, depth=depth).collect()}
        for k in symbols:
            assert abs(got[k] - brute_symbols([x for j in (1, 2, 6) for x in symbols[j](depth)], [x for j in (3, 4, 5) for x in symbols[j](depth)], symbols[k](depth), depth)) < 1e-5
    assert abs(got[3] - got[4]) > 1e-3  # the same words in another order
    # small batches and many tasks give the same
    small = {r.doc_id: r.score for r in ctw.score(rows.repartition(3, "doc_id"), batch_bytes=8).collect()}
    assert all(abs(small[k] - got[k]) < 1e-5 for k in got)


def brute_symbols(train, other, test, depth):
    """log10 probability of the (context, byte) pairs ``test``, by recursion over all contexts."""
    nodes = lambda c, x: [((c[depth - d :], (1 << j) | (x >> (8 - j))), (x >> (7 - j)) & 1, d) for j in range(8) for d in range(depth + 1)]
    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for seen, pairs in ((1, train), (0, other)):
        for c, x in pairs:
            for node, bit, d in nodes(c, x):
                counts[node][bit] += seen
                if d < depth:
                    kids[node].add((c[depth - d - 1 :], node[1]))
    memo = {}

    def weights(node):
        if node not in memo:
            a, b = counts[node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(node[0]) == depth:
                memo[node] = own, 1.0
            else:
                below = sum(weights(k)[0] for k in kids[node])
                log_pw = max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
                memo[node] = log_pw, math.exp(own - math.log(2) - log_pw)
        return memo[node]

    total = 0.0
    for c, x in test:
        for j in range(8):
            p = 0.0
            for d in range(depth, -1, -1):
                node = (c[depth - d :], (1 << j) | (x >> (8 - j)))
                a, b = counts[node]
                beta = weights(node)[1]
                p = beta * (((b if (x >> (7 - j)) & 1 else a) + 0.5) / (a + b + 1)) + (1 - beta) * p
            total += math.log10(p)
    return total


def test_quality(spark, docs, empty):
    good = [(k, prose(60, k)) for k in range(150)]
    bad = [(1000 + k, "!! ".join(prose(40, k).upper().split()) + " | " * 9) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    held = [r for r in quality.score(table, model).withColumn("h", quality.fold()).collect() if r.h == 0]
    assert held and sum((r.score >= 0.3) == (r.doc_id < 1000) for r in held) >= 0.95 * len(held)
    assert zlib.crc32(b"5") % 5 == spark.range(5, 6).select(quality.fold("id")).first()[0]
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    assert quality.score(docs, quality.train(docs, labels.limit(0))).filter("score = 0.5").count() == len(ROWS)


PAGES = [
    ("<html lang=en><body><nav><a href=/>Home</a></nav><header>Site</header><div class='ad-box'>Buy</div><main><h1>Title &amp; more</h1><p>One  two<br>three<p>Four<ul><li>x<li>y</ul></main><aside>Side</aside><div id=comments>Nice!</div><footer>c</footer>", "Title & more\nOne two\nthree\nFour\nx\ny"),
    ("<div><div class=menu><a>a</a></div><div><h2>Head</h2><p>" + "word " * 40 + "</p><p>" + "text " * 30 + "</p></div><form>f<input></form><script>var t='</p>'</script></div>", "Head\n" + "word " * 39 + "word\n" + "text " * 29 + "text"),
    (None, ""), ("", ""), ("<<<>>> & < b", "<<<>>> & < b"), ("just text", "just text"),
]


def test_extract(spark):
    rows = spark.createDataFrame([(k, "u", h, 1) for k, (h, _) in enumerate(PAGES)] + [(None, None, None, 1)], "page_id long, url string, html string, text int")
    got = extract.extract(rows).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None} == {k: t for k, (_, t) in enumerate(PAGES)}
    assert extract.extract(rows.limit(0)).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([("some text", "a"), ("more text", "b"), ("other text", "c")], "text string, lang string")
    monkeypatch.setattr(langid, "LANGS_BOUND", 3)
    assert langid.learn(docs)[0] == ["a", "b", "c"]
    monkeypatch.setattr(langid, "LANGS_BOUND", 2)
    with pytest.raises(ValueError, match="3 languages"):
        langid.learn(docs)



def test_language(spark):
    en, fr = "the and of that with this have from they been", "les des une pour dans avec sur pas plus est"
    docs = spark.createDataFrame([("en", " ".join(random.Random(k).choices(en.split(), k=50))) for k in range(20)] + [("fr", " ".join(random.Random(k).choices(fr.split(), k=50))) for k in range(20)] + [(None, "x"), ("de", None)], "lang string, text string")
    pages = [(k, f"http://a{k % 3}.example.fr/x", "<html lang='fr'><p>" + " ".join(random.Random(k).choices(fr.split(), k=30))) for k in range(9)] + [(20 + k, "http://b.example.com", "<p>" + en) for k in range(6)] + [(40, "http://a1.example.fr/", None), (41, None, "<html lang=en>" + en)]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert all(got[k].lang == "fr" for k in [*range(9), 40]) and all(got[k].lang == "en" for k in [*range(20, 26), 41])
    assert langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0)).filter("lang = 'und'").count() == len(pages)


def test_queries_hash(spark):
    row = queries.op3_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    assert row.n_turns == 2 and row.loss_sha256 == hashlib.sha256(queries.PROBE.encode()).hexdigest()

"""Operators that queries cannot show: snapshots, streams, embedding, and cases worked out by hand."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.config import EngineConfig
from noteloom.functions import metadata, names, phrases, sections, values
from noteloom.operators import answer, chunk, citations, embed, index, models, paged, resolve, route, search
from noteloom.sources import files, snapshots
from noteloom.streaming import events


def one(spark, column, **given):
    """A column over one row of the given texts."""
    schema = ", ".join(f"{k} string" for k in given)
    return spark.createDataFrame([tuple(given.values())], schema).select(column.alias("x")).first().x


# ---------------------------------------------------------------- questions


@pytest.mark.parametrize(
    ("question", "phrase"),
    [
        ("What does Foundations of Computing say for section 1.5?", "Foundations of Computing"),
        ("section 1.5 of Foundations of Computation", "Foundations of Computation"),
        ("section 1.5 in my Foundations of Computation book", "Foundations of Computation"),
        ("Can you explain what section 1.5 talks about in my Foundations of Computation book?", "Foundations of Computation"),
        ("What is section 1.5 about from the Foundations of Computation PDF?", "Foundations of Computation"),
        ("In my Foundations of Computation book, explain section 1.5.", "Foundations of Computation"),
        ("Foundations of Computation section 1.5", "Foundations of Computation"),
        ("According to Discrete Maths, what is induction?", "Discrete Maths"),
        ("What about section 1.5 again?", None), ("Can you create a lecture for section 1.5?", None), ("Make slides for section 1.5.", None), ("Explain this", None), ("", None), ("   ", None), ("the", None),
    ],
)
def test_requested_phrase(spark, question, phrase):
    assert one(spark, phrases.requested_source_phrase(F.col("q")), q=question) == phrase


@pytest.mark.parametrize(
    ("question", "lecture"),
    [("Explain this slide by slide", True), ("build a presentation from chapter 2", True), ("write a tutorial on x", False), ("class slides please", True), ("Produce\n a  slide deck", True), ("teach me about sets", False), ("the lecturer was late", False), ("lesson about trees", True), ("make it short", False)],
)
def test_lecture_request(spark, question, lecture):
    assert one(spark, phrases.is_lecture_request(F.col("q")), q=question) is lecture


@pytest.mark.parametrize(("question", "number"), [("section 1.5", "1.5"), ("Sec. 2.3.4?", "2.3.4"), ("§4.1", "4.1"), ("section 1", None), ("intersection 1.5", None), ("section1.5", None), ("see § 2.2 and section 3.3", "3.3"), ("section 1.2.3.4.5.6", "1.2.3.4.5")])
def test_section_request(spark, question, number):
    assert one(spark, phrases.section_request(F.col("q")), q=question) == number


@pytest.mark.parametrize(("name", "normal"), [("FoundationsOfComputation_2.3.1.pdf", "foundations of computation"), ("résumé-final.md", "re sume"), ("Chapter 3.pdf", "chapter 3"), ("final", "final"), ("scan_6x9_v1.2", "scan"), ("A/B\\C", "a b c"), ("—", "")])
def test_normal_names(spark, name, normal):
    assert one(spark, names.normalize_name(F.col("n")), n=name) == normal


def test_scores_and_margins(spark):
    sources = spark.createDataFrame([("b/foc.pdf", "foc.pdf", "Foundations of Computation"), ("b/alg.pdf", "alg.pdf", "Linear Algebra"), ("c/alg2.pdf", "alg2.pdf", "Linear Algebra II")], "path string, file_name string, title string")
    asks = spark.createDataFrame([(1, "What does Foundations of Computing say?"), (2, "section 1.1 of Linear Algebr"), (3, "make slides"), (4, "section 2.2 of Underwater Basketry")], "q_id long, text string")
    got = {r.q_id: (r.path, r.confidence) for r in resolve.resolve(asks, sources).collect()}
    assert got[1] == ("b/foc.pdf", 99) and 3 not in got and 4 not in got
    near = resolve.suggest(asks, sources).filter("q_id = 2").orderBy("rank").collect()
    assert [r.path for r in near][:2] == ["b/alg.pdf", "c/alg2.pdf"]
    assert one(spark, names.token_dice(names.canonical_tokens(F.col("a")), names.canonical_tokens(F.col("b"))), a="computers tables tables", b="computing table chair") == pytest.approx(2 * 2 / 6)
    # Words without Latin letters are compared as they are.
    assert one(spark, names.token_dice(names.canonical_tokens(F.col("a")), names.canonical_tokens(F.col("b"))), a="анализ данных", b="теория чисел") == 0


def test_unknown_source_ends_the_search(spark):
    sources = spark.createDataFrame([("foc.pdf", "foc.pdf", "Foundations of Computation")], "path string, file_name string, title string")
    rows = [
        (1, 0, "user", "section 1.1 of Foundations of Computation", []), (1, 1, "assistant", "", ["foc.pdf"]), (1, 2, "user", "What about section 1.5 again?", []),
        (2, 0, "user", "section 1.1 of Foundations of Computation", []), (2, 2, "user", "section 1.5 of Underwater Basketry", []),
        (3, 0, "user", "hello", []), (3, 1, "assistant", "", ["x.pdf", "x.pdf", ""]), (3, 2, "user", "Explain section 2.2", []),
        (4, 1, "assistant", "", ["x.pdf", "y.pdf"]), (4, 2, "user", "Explain section 2.2", []),
    ]
    got = {r.conv_id: (r.path, r.confidence, r.origin) for r in resolve.resolve_with_history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cited array<string>"), sources).collect()}
    assert got == {1: ("foc.pdf", 100, "conversation"), 2: (None, None, "unresolved"), 3: ("x.pdf", 100, "answer"), 4: (None, None, "unresolved")}


def test_integrity_is_checked(spark):
    asked = spark.createDataFrame([(1, "a.pdf", "1.2"), (2, "a.pdf", "9.9")], "q_id long, path string, section string")
    hits = spark.createDataFrame([(1, "a.pdf", "1.2"), (1, "b.pdf", "1.2"), (1, "a.pdf", "1.20")], "q_id long, path string, section_number string")
    got = {r.q_id: r for r in route.section_integrity(asked, hits).collect()}
    assert (got[1].n, got[1].n_bad, got[1].bad_paths, got[1].bad_sections, got[1].sound) == (3, 2, ["a.pdf", "b.pdf"], ["1.2", "1.20"], False) and not got[2].sound


# ---------------------------------------------------------------- chunks and lines


def test_markdown_chunks(spark):
    text = "# A\nx\n## C#\ny\n```\n# no\n" + "z" * 3000 + "\n```\n\t\nw\n# B ##\n" + "v" * 5000 + "\nu"
    got = [(r.heading, r.content[:4], len(r.content)) for r in chunk.chunk_markdown(spark.createDataFrame([("p.md", text)], "path string, text string")).collect()]
    assert got == [("A", "x", 1), ("A > C", "y\n``", 3015), ("A > C", "w", 1), ("B", "vvvv", 5000), ("B", "u", 1)]


def test_paged_chunks(spark):
    pages = [(1, ["CHAPTER", "1.", "5", "Deduction", "body  one", "1.5. DEDUCTION", "more"]), (2, ["1.5 DEDUCTION", "tail", "Chapter II Sets", "free", "2.1 volts are applied.", "Contents ..... 3"])]
    rows = paged.chunk_pages(spark.createDataFrame([("a.pdf", pages), ("b.pdf", []), ("c.pdf", [(1, [" ", ""])])], "path string, pages array<struct<page_number:int,lines:array<string>>>")).collect()
    assert [(r.heading, r.section_number, r.content, r.page_start, r.page_end) for r in rows] == [
        ("CHAPTER", "", "CHAPTER", 1, 1), ("1.5 Deduction", "1.5", "1.5 Deduction\nbody one\nmore\ntail", 1, 2), ("Chapter II Sets", "", "Chapter II Sets\nfree\n2.1 volts are applied.\nContents ..... 3", 2, 2),
    ]


def test_lines_of_pieces(spark):
    items = [("Hello", 700.0, False), ("(", 700.5, False), ("world", 700.0, False), (")", 700.0, False), ("co-", 690.0, False), ("op", 690.0, True), (" ", 680.0, False), (None, 1.0, True), ("end", None, False), (".", None, False)]
    got = spark.createDataFrame([(items,)], "items array<struct<str:string,y:double,eol:boolean>>").select(paged.reconstruct_lines(F.col("items")).alias("x")).first().x
    assert got == ["Hello (world)", "co-op", "end."]


def test_titles(spark):
    for title, good in (("Deduction", True), ("deduction", False), ("Deduction 33", False), ("A. B", True), ("It ends.", False), ("ALL CAPS!", True), ("1234 things", False), (" – Dash", True), ("Élan", True), ("word " * 19, False), ("", False)):
        assert one(spark, sections.is_section_title(F.col("t")), t=title) is good, title


# ---------------------------------------------------------------- snapshots


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "id long, text string")
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, root)
    assert snapshots.save(rows, root) and not snapshots.save(rows.repartition(7).orderBy(F.col("id").desc()), root)
    more = rows.union(spark.createDataFrame([(1, "t1")], rows.schema))
    assert snapshots.save(more, root) and snapshots.load(spark, root).count() == 51
    # A snapshot without a pointer, as a writer leaves that dies, is not seen; going back to old rows is.
    rows.limit(3).write.parquet(f"{root}/snapshots/half")
    assert snapshots.load(spark, root).count() == 51 and snapshots.save(rows, root) and snapshots.load(spark, root).count() == 50
    assert snapshots.tidy(spark, root, keep=1) == 1
    shutil.rmtree(tmp_path / "index" / "snapshots" / snapshots.current(spark, root))
    with pytest.raises(FileNotFoundError, match="missing"):
        snapshots.load(spark, root)


def test_persist_and_manifest(spark, tmp_path):
    root = f"file://{tmp_path}/notes"
    sources = spark.createDataFrame([("f/a.md", "markdown", None, 5, None, None, None)], "path string, source_type string, title string, mtime long, tags array<string>, links array<string>, properties array<string>")
    rows = chunk.chunk_rows(chunk.chunk_markdown(spark.createDataFrame([("f/a.md", "# H\none\n# I\ntwo")], "path string, text string")), sources)
    manifest = snapshots.manifest_of(rows, spark.createDataFrame([("f/a.md", "h")], "path string, hash string"))
    first = manifest.first()
    assert (first.chunk_ids, first.title, first.page_count, rows.first().folder) == (["f/a.md::0", "f/a.md::1"], "a", 0, "f")
    assert not snapshots.checkpoint_saved(spark, root)
    snapshots.persist(sources.select("path"), rows, manifest, root, checkpoint="run")
    assert snapshots.checkpoint_saved(spark, root) and snapshots.load(spark, f"{root}/manifest").count() == 1
    snapshots.point(spark, f"{root}/checkpoint", "saving")
    assert not snapshots.checkpoint_saved(spark, root)
    snapshots.clear_checkpoint(spark, root)
    assert snapshots.current(spark, f"{root}/checkpoint") is None
    assert snapshots.due(2000, 0) and snapshots.due(1, 1200) and not snapshots.due(1999, 1199)
    assert snapshots.create_empty(spark, rows.schema).count() == 0


def test_notes_of_a_folder(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for name in ("a.md", "n/b.md", "c.txt"):
        (tmp_path / name).write_text(f"# {name}\n")
    got = files.read_notes(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.md", "b.md"]
    assert files.pruned(spark.createDataFrame([("x",), ("y",)], "path string"), spark.createDataFrame([("y",)], "path string")).count() == 1


# ---------------------------------------------------------------- feeds


def test_shuffled_feed_equals_a_rebuild(spark):
    r = random.Random(6)
    rows, state = [], {}
    for k in range(300):
        kind, path, old = r.choice(["create", "modify", "delete", "rename"]), f"p{r.randint(0, 15)}", f"p{r.randint(0, 15)}"
        rows.append((k, k // 3, path, old if kind == "rename" and old != path else f"gone{k}", kind))
        if kind == "rename":
            state.pop(rows[-1][3], None)
        state.pop(path, None)
        if kind != "delete":
            state[path] = "new"
    r.shuffle(rows)
    feed = spark.createDataFrame(rows, "event_id long, ts long, path string, old_path string, kind string")
    sources = spark.createDataFrame([(f"p{k}", "h") for k in range(16)], "path string, hash string")
    index_ = spark.createDataFrame([(f"p{k}", "old") for k in range(20)], "path string, version string")
    out = events.apply_steps(index_, events.steps(feed), sources.limit(0), sources, lambda s: s.select("path", F.lit("new").alias("version")))
    got = {x.path: x.version for x in out.collect()}
    touched = {x[2] for x in rows} | {x[3] for x in rows if x[4] == "rename"}
    assert got == state | {f"p{k}": "old" for k in range(20) if f"p{k}" not in touched}
    again = events.apply_steps(out, events.steps(feed), sources, sources, lambda s: s.select("path", F.lit("twice").alias("version")))
    assert {x.path: x.version for x in again.collect()} == got  # a replay changes nothing


def test_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, path string, kind string"
    burst = [(1, "2024-01-01 00:00:00", "a", "create"), (2, "2024-01-01 00:00:01", "a", "modify"), (3, "2024-01-01 00:00:05", "a", "delete"), (4, "2024-01-01 00:00:00", "b", "modify")]
    late = [(9, "2024-01-01 01:00:00", "z", "modify")]
    make = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, path string, kind string").withColumn("ts", F.to_timestamp("ts"))
    seen = []
    for rows in (burst, late):
        make(rows).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        query = events.run_stream(spark.readStream.schema(schema).json(f"{tmp_path}/in"), lambda df, _: seen.extend((r.path, r.kind, r.n_events) for r in df.collect()), f"{tmp_path}/state")
        query.processAllAvailable()
        query.stop()
    assert sorted(seen) == [("a", "delete", 1), ("a", "modify", 2), ("b", "modify", 1)]
    whole = {(r.path, r.kind, r.n_events) for r in events.debounced(make(burst)).collect()}
    assert set(seen) == whole


# ---------------------------------------------------------------- embedding and answers


def test_embedding(spark):
    model = embed.HashedEmbedder(16)
    rows = spark.createDataFrame([(k, f"word{k % 7} other" if k else None) for k in range(150)], "id long, embedding_text string").repartition(3)
    got = {r.id: r.embedding for r in embed.embedded(rows, model).collect()}
    assert all(got[k] == pytest.approx(model.embed([f"word{k % 7} other"])[0], abs=1e-6) for k in range(1, 150)) and got[0] == [0.0] * 16
    assert sum(x * x for x in got[5]) == pytest.approx(1, abs=1e-5)
    assert embed.kept_tokens(list("abcdef"), 4) == ["a", "b", "c", "f"] and embed.kept_tokens(["a"]) == ["a"]

    class Short(embed.HashedEmbedder):
        def embed(self, texts):
            return super().embed(texts)[1:]

    with pytest.raises(Exception, match="vectors for"):
        embed.embedded(rows, Short(16)).count()


def test_budgets():
    assert (EngineConfig(lecture_chunks=99).lecture_chunk_limit, EngineConfig(lecture_chunks=0).lecture_chunk_limit, EngineConfig(lecture_chars=1).lecture_char_limit, EngineConfig(history_chars=-1).history_char_limit, EngineConfig(history_chars=0).history_char_limit) == (12, 8, 4000, 2000, 0)
    assert EngineConfig(vector_weight=2.0).text_weight == 0 and EngineConfig(lecture_chunks=float("nan")).lecture_chunk_limit == 8


def test_history_shares(spark):
    rows = spark.createDataFrame([(1, k, "user", "x" * 3000) for k in range(5)] + [(2, 0, "user", "y" * 3000)], "conv_id long, turn long, role string, text string")
    got = answer.generation_history(rows, lecture=True).collect()
    assert sorted((r.conv_id, r.turn, len(r.text)) for r in got) == [(1, 3, 1000), (1, 4, 1000), (2, 0, 2000)]
    assert answer.generation_history(rows, lecture=False).count() == 5
    assert answer.generation_history(rows, lecture=True, cfg=EngineConfig(history_chars=0)).count() == 0


def test_blocked_questions_get_no_prompt(spark):
    q = spark.createDataFrame([(1, "one", False, None), (2, "two", True, "source-unresolved"), (3, "three", True, None)], "q_id long, text string, lecture boolean, blocked_reason string")
    c = spark.createDataFrame([(1, "ctx"), (2, "ctx")], "q_id long, context string")
    assert [r.q_id for r in answer.prompts(q, c).collect()] == [1]
    free = {r.q_id: r for r in answer.prompts(q, c, EngineConfig(only_sources=False)).collect()}
    assert set(free) == {1, 3} and "(none)" in free[3].user and "slide by slide" in free[3].system and "slide by slide" not in free[1].system


def test_failed_turns_stay_out_of_the_context(spark):
    turns = spark.createDataFrame([(1, 0, "q", "a", "complete", None), (1, 1, "q", None, "error", "boom"), (1, 2, "q", None, "stopped", None)], "conv_id long, turn long, question string, answer string, state string, failure string")
    kept = answer.kept_turns(turns)
    assert kept.count() == 6 and answer.context_messages(kept).count() == 4 and kept.filter("text = 'boom'").count() == 1


def test_messages_of_errors(spark):
    assert one(spark, values.failure_message(F.col("e"), F.col("p")), e="a ``` b", p="half").count("```") == 2
    assert one(spark, values.is_duplicate_id_error(F.col("e")), e="Document already exists") and not one(spark, values.is_duplicate_id_error(F.col("e")), e="no space left")
    assert one(spark, metadata.properties(F.col("j")), j='{"a": {"b": [1, {"c": true}]}, "position": 1}') == ["a.b=1", "a.b.c=true"] and one(spark, metadata.properties(F.col("j")), j="[1]") == []


def test_near_terms(spark):
    terms = spark.createDataFrame([(1, "tree"), (2, "a")], "q_id long, term string")
    words = spark.createDataFrame([(w,) for w in ("tree", "trees", "tee", "free", "three", "street", "eert", "b", "ab", "")], "term string")
    got = {(r.q_id, r.term) for r in search.near_terms(terms, words).collect()}
    assert got == {(1, w) for w in ("tree", "trees", "tee", "free", "three")} | {(2, w) for w in ("b", "ab")}


def test_citation_of_a_row(spark):
    hits = spark.createDataFrame([(1, 1, "a.PDF", 3.7, 2.0, "1.2", None)], "q_id long, rank int, path string, page_start double, page_end double, section_number string, heading string").withColumn("section_title", F.lit("Sets"))
    assert hits.select(citations.label(F.col("rank")).alias("x")).first().x == "[1] a.PDF (PDF p. 3) → §1.2 Sets"
    assert hits.select(citations.target(F.col("path")).alias("x")).first().x == "a.PDF#page=3"
    assert citations.cited_sources(citations.retrieved(hits)).columns == ["q_id", "rank", *citations.CITED]


def test_retry_while_busy(spark):
    asked = spark.createDataFrame([("a.md",)], "path string")
    out = index.retry_outcomes(asked, asked, spark.createDataFrame([], "path string, error string"), ready=False)
    assert out.first().outcome == "busy"


# ---------------------------------------------------------------- models


def test_leases():
    gone = []
    leases = models.Leases(gone.append)
    with leases.hold("a", "b", "a", ""):
        assert leases.unload("c") and gone == ["c"]
        assert not leases.unload("a") and gone == ["c"]
        with pytest.raises(RuntimeError, match="a is about"), leases.hold("a"):
            pass
        with leases.hold("b"):
            pass
    assert gone == ["c", "a"]
    with leases.hold("a"):
        pass


def test_catalog_is_renewed(spark):
    old = spark.createDataFrame([("s", "m", ["completion"], None)], "server string, name string, capabilities array<string>, error string")
    listed = spark.createDataFrame([("m",), ("n",), ("o",), ("m",)], "name string")
    details = spark.createDataFrame([("m", ["embedding"], None), ("n", None, "timed out")], "name string, capabilities array<string>, error string")
    got = {r.name: (r.capabilities, r.error) for r in models.renewed_catalog(old, listed, details, "s", "s").collect()}
    assert got == {"m": (["embedding"], None), "n": (None, "timed out"), "o": (None, "no answer")}
    assert models.renewed_catalog(old, listed, details, "s", "t").count() == 0


def test_options(spark):
    rows = spark.createDataFrame([(False, "GPT-OSS:20b"), (True, "qwen3:8b"), (False, "qwen3"), (True, "other")], "lecture boolean, model string")
    got = [r.o for r in rows.select(models.chat_options(F.col("lecture"), F.col("model"), effort="high", threads=4, lecture_context=9).alias("o")).collect()]
    assert [o.think for o in got] == ["high", "false", "true", "high"] and [o.num_ctx for o in got] == [None, 9, None, 9] and got[0].num_thread == 4 and got[0].keep_alive is None


def test_adapters(spark):
    def send(path, body):
        return {"embeddings": [[float(len(x)), 1.0] for x in body["input"]]} if path == "/api/embed" else {"message": {"content": body["messages"][1]["content"].upper()}}

    rows = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, embedding_text string")
    assert {r.id: r.embedding for r in embed.embedded(rows, models.ServedEmbedder(send, "m", 2)).collect()} == {1: [2.0, 1.0], 2: [3.0, 1.0]}
    prompts = spark.createDataFrame([(7, "s", "hi")], "q_id long, system string, user string")
    assert [(r.q_id, r.answer) for r in models.ServedGenerator(send, "m").answer(prompts).collect()] == [(7, "HI")]
    out = models.token_vectors({"x": np.zeros((1, 2)), "y": np.array([[[3.0, 4.0], [9.0, 9.0]]])})
    assert models.pooled(out, np.array([[1, 0]])).tolist() == [[0.6, 0.8]] and models.pooled(out, np.array([[0, 0]])).tolist() == [[0.0, 0.0]]

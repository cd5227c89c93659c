"""The engine's registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import codec
from ..functions import names as N
from ..functions import text as T
from ..operators import chunk, context, index, search
from ..sources.files import documents_as_sources, indexable, spread, table
from ..streaming import events as feed
from . import answers, paged, resolution, upkeep  # noqa: F401  these register their queries too
from .registry import ORACLE, QUERIES, query  # noqa: F401

CFG = EngineConfig()


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return documents_as_sources(spread(table(spark, d, "documents")))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every item whose id is divisible by 100."""
    return table(spark, d, "benchmark").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("q_id"), "text")


# ---------------------------------------------------------------- sources


@query("select source || '/' || doc_id || '.md' as path, sha256(text) as hash from documents")
def src_hash(spark, d):
    return index.source_hash(_sources(spark, d)).select("path", "hash")


@query("select source || '/' || doc_id || case doc_id % 3 when 0 then '.md' when 1 then '.PDF' else '.txt' end as path from documents where doc_id % 3 < 2")
def src_indexable(spark, d):
    ext = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".PDF").otherwise(".txt")
    return indexable(table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path")))


@query("select doc_id, length(text) as n from documents where length(text) < 20")
def no_text_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).filter("n < 20")


# ---------------------------------------------------------------- chunking


@query("select doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) as head, sha256(text) as body_sha256 from documents")
def chunk_frontmatter(spark, d):
    docs = table(spark, d, "documents").withColumn("head", F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---\n")))
    return docs.select("doc_id", "head", F.sha2(T.strip_frontmatter(F.concat("head", "text")), 256).alias("body_sha256"))


@query("with l as (select source || '/' || doc_id || '.md' as path, len(string_split(text, chr(10))) as n from documents) select path, p as part, least(64, n - 64 * p) as n_chunks from l, range(10000) t(p) where 64 * p < n")
def portable_objects(spark, d):
    lines = _sources(spark, d).select("path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return index.portable_objects(lines).select("path", "part", "n_chunks")


# ---------------------------------------------------------------- search

_TOK = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_POST = f"w as (select doc_id as id, {_TOK.format('text')} as ws from documents), t as (select id, unnest(ws) as term, len(ws) as dl from w), p as (select id, term, count(*) as tf, any_value(dl) as dl from t group by id, term)"


@query(f"with {_POST} select term, count(*) as df, cast(sum(tf) as bigint) as cf from p group by term")
def term_stats(spark, d):
    return search.term_stats(search.postings(_docs(spark, d)))


_BM25 = (
    f"{_POST}, s as (select count(*) as n, avg(len(ws)) as avgdl from w), df as (select term, count(*) as df from p group by term), "
    f"q as (select distinct item_id as q_id, unnest({_TOK.format('text')}) as term from benchmark where item_id % 100 = 0), "
    "h as (select q.q_id, p.id, sum(ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) as score from q join p using (term) join df using (term), s group by q.q_id, p.id)"
)


def _rounded(hits: DataFrame, k: int) -> DataFrame:
    return search.top(hits.withColumn("score", r6(F.col("score"))), k).select("q_id", "id", "score", "rank")


@query(f"with {_BM25}, r as (select q_id, id, round(score, 6) as score from h) select q_id, id, score, cast(row_number() over (partition by q_id order by score desc, id) as int) as rank from r qualify rank <= 8")
def bm25_search(spark, d):
    return search.bm25(_questions(spark, d), _docs(spark, d), CFG.top_k, places=6).select("q_id", "id", "score", "rank")


@query(f"with {_BM25}, r as (select q_id, id, round(score, 6) as score from h join documents on doc_id = id where source = 'src1') select q_id, id, score, cast(row_number() over (partition by q_id order by score desc, id) as int) as rank from r qualify rank <= 6")
def search_source_restricted(spark, d):
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    return search.bm25(_questions(spark, d), docs, 6, places=6, within=F.col("source") == "src1").select("q_id", "id", "score", "rank")


@query(
    f"with d as (select doc_id as id, string_split(text, chr(10))[1] as heading, text as content, [lang, source] as tags from documents), x as (select id, 'heading' as field, {_TOK.format('heading')} as t from d union all select id, 'content', {_TOK.format('content')} from d union all select id, 'tags', {_TOK.format("array_to_string(tags, ' ')")} from d), "
    "st as (select field, count(*) as n, avg(len(coalesce(t, []))) as avgdl from x group by field), p as (select id, field, term, count(*) as tf, any_value(dl) as dl from (select id, field, unnest(t) as term, len(t) as dl from x) z group by id, field, term), df as (select field, term, count(*) as df from p group by field, term), "
    f"q0 as (select distinct item_id as q_id, unnest({_TOK.format('text')}) as a from benchmark where item_id % 100 = 0), q as (select distinct q_id, v.term from q0 join (select distinct term from p) v on abs(length(v.term) - length(a)) <= 1 and levenshtein(v.term, a) <= 1), "
    "h as (select q_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) as score from q join p using (term) join df using (field, term) join st using (field) group by q_id, p.id) "
    "select q_id, id, score, cast(row_number() over (partition by q_id order by score desc, id) as int) as rank from h qualify rank <= 8"
)
def fielded_search(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("heading"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"))
    return search.fielded(_questions(spark, d), spread(rows), 8, ("heading", "content", "tags"), tolerance=1, places=5).select("q_id", "id", "score", "rank")


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double))) / sqrt(list_sum(list_transform(a.embedding, lambda z: cast(z as double) * cast(z as double))) * list_sum(list_transform(b.embedding, lambda z: cast(z as double) * cast(z as double))))"
_VEC = f"v as (select a.vec_id as q_id, b.vec_id as id, round({_COS}, 6) as score from embeddings a, embeddings b where a.vec_id % 100 = 0)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(f"with {_VEC} select q_id, id, score, cast(row_number() over (partition by q_id order by score desc, id) as int) as rank from v qualify rank <= 8")
def vector_topk(spark, d):
    return search.vector_search(*_vectors(spark, d), 8, -2.0, places=6).select("q_id", "id", "score", "rank")


@query(f"with {_VEC} select q_id, id, score from v where score >= 0.35")
def vector_threshold(spark, d):
    return search.vector_matches(*_vectors(spark, d), least=CFG.min_similarity, places=6)


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda z: cast(z as double) * cast(z as double)))), 5) as norm from embeddings")
def vector_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(search.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query(
    f"with {_BM25}, {_VEC}, lt as (select q_id, id, round(score, 6) as score from h qualify row_number() over (partition by q_id order by round(score, 6) desc, id) <= 50), "
    "lv as (select q_id, id, score from v where score >= 0.35 qualify row_number() over (partition by q_id order by score desc, id) <= 50), "
    "a as (select q_id, id, score / max(score) over (partition by q_id) as t from lt), b as (select q_id, id, score / max(score) over (partition by q_id) as v from lv), "
    "f as (select coalesce(a.q_id, b.q_id) as q_id, coalesce(a.id, b.id) as id, round(0.45 * coalesce(t, 0) + 0.55 * coalesce(v, 0), 6) as score from a full outer join b on a.q_id = b.q_id and a.id = b.id) "
    "select q_id, id, score, cast(row_number() over (partition by q_id order by score desc, id) as int) as rank from f qualify rank <= 8"
)
def hybrid_search(spark, d):
    lexical = search.bm25(_questions(spark, d), _docs(spark, d), 50, places=6)
    q, v = _vectors(spark, d)
    vector = search.vector_search(q, v, 50, CFG.min_similarity, places=6)
    return _rounded(search.fuse(lexical, vector, 1 << 30).select("q_id", "id", "score"), 8)


@query(
    f"with {_BM25}, {_VEC}, s1 as (select doc_id as id from documents where source = 'src1'), lt as (select q_id, id, round(score, 6) as score from h where id in (select id from s1) qualify row_number() over (partition by q_id order by round(score, 6) desc, id) <= 50), "
    "lv as (select q_id, id, score from v where score >= 0.1 and id in (select id from s1) qualify row_number() over (partition by q_id order by score desc, id) <= 50), "
    "a as (select q_id, id, score / max(score) over (partition by q_id) as t from lt), b as (select q_id, id, score / max(score) over (partition by q_id) as v from lv), "
    "f as (select coalesce(a.q_id, b.q_id) as q_id, coalesce(a.id, b.id) as id, round(0.45 * coalesce(t, 0) + 0.55 * coalesce(v, 0), 6) as score from a full outer join b on a.q_id = b.q_id and a.id = b.id) "
    "select q_id, id, score, cast(row_number() over (partition by q_id order by score desc, id) as int) as rank from f qualify rank <= 6"
)
def hybrid_source_restricted(spark, d):
    """Both lists are restricted to the source before anything is scored."""
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    own = docs.filter("source = 'src1'").select("id")
    lexical = search.bm25(_questions(spark, d), docs, 50, places=6, within=F.col("source") == "src1")
    q, v = _vectors(spark, d)
    vector = search.vector_search(q, v.join(own, "id", "left_semi"), 50, 0.1, places=6)
    return _rounded(search.fuse(lexical, vector, 1 << 30).select("q_id", "id", "score"), 6)


@query("select doc_id, source, lang from documents where doc_id in (select vec_id from embeddings where label = 3)")
def chunks_by_id(spark, d):
    ids = table(spark, d, "embeddings").filter("label = 3").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", "lang").join(ids, "doc_id", "left_semi")


# ---------------------------------------------------------------- context

_RANKED = "r as (select source as q_id, doc_id, text as content, row_number() over (partition by source order by doc_id) as rank from documents)"


def _ranked(spark, d):
    """The rows to choose from, with lengths instead of texts; a document's id is its rank."""
    return table(spark, d, "documents").select(F.col("source").alias("q_id"), "doc_id", F.col("doc_id").alias("rank"), F.length("text").alias("chars"))


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


@query(f"with {_RANKED}, u as (select *, sum(length(content)) over (partition by q_id order by rank rows unbounded preceding) as used from r) select q_id, doc_id, rank, cast(used as bigint) as used from u where rank <= 6 and (rank = 1 or used <= 18000)")
def context_budget(spark, d):
    return context.budget(_ranked(spark, d), CFG.context_chunks, CFG.context_chars).select("q_id", "doc_id", F.col("n").cast("long").alias("rank"), "used")


@query(f"with {_RANKED}, c as (select *, count(*) over (partition by q_id) as n from r) select q_id, doc_id from c where n <= 8 or (rank - 1) in (select floor(p * (n - 1) / 7.0 + 0.5) from range(8) t(p))")
def even_sample(spark, d):
    return context.even_sample(_ranked(spark, d), 8).select("q_id", "doc_id")


@query(
    f"with {_RANKED}, u as (select *, sum(length(content)) over (partition by q_id order by rank rows unbounded preceding) as used from r), k as (select * from u where rank <= 6 and (rank = 1 or used <= 18000)) "
    "select q_id, sha256(string_agg('[' || rank || '] ' || doc_id || ' - Document' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as context_sha256, count(*) as n_chunks from k group by q_id"
)
def rag_context(spark, d):
    kept = context.budget(_ranked(spark, d), CFG.context_chunks, CFG.context_chars).join(_texts(spark, d), "doc_id")
    return context.assemble(kept.withColumn("path", F.col("doc_id").cast("string")).withColumn("heading", F.lit("Document"))).select("q_id", F.sha2("context", 256).alias("context_sha256"), "n_chunks")


_CUT = "case when length(text) <= {m} then text else substr(text, 1, {h}) || chr(10) || chr(10) || '[... middle of the text left out here ...]' || chr(10) || right(text, {t}) end"


def _cut_sql(most: int) -> str:
    room = most - len(T.MARKER)
    head = -(-room * 65 // 100)
    return _CUT.format(m=most, h=head, t=room - head)


@query(f"select doc_id, sha256({_cut_sql(600)}) as cut_sha256 from documents")
def truncate_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.truncate(F.col("text"), 600), 256).alias("cut_sha256"))


# ---------------------------------------------------------------- conversations


@query("select conv_id, count(*) as n_messages, max(turn) as last_turn, count_if(role = 'user') as n_user from conversations group by conv_id")
def conv_list(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("n_user"))


@query(
    "select conv_id, case when t = '' then 'New chat' when length(t) <= 48 then t else substr(t, 1, 45) || '...' end as title from "
    "(select conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) as t from conversations where role = 'user' group by conv_id) x"
)
def conv_title(spark, d):
    first = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", T.conversation_title(F.col("t")).alias("title"))


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 6")
def conv_last_k(spark, d):
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return table(spark, d, "conversations").withColumn("k", rank).filter("k <= 6").select("conv_id", "turn", "role")


@query("select conv_id, turn, role from conversations where not (role = 'assistant' and turn % 5 = 3)")
def conv_history_clean(spark, d):
    state = F.when((F.col("role") == "assistant") & (F.col("turn") % 5 == 3), "error").otherwise("complete")
    return table(spark, d, "conversations").withColumn("request_state", state).filter("request_state <> 'error'").select("conv_id", "turn", "role")


# ---------------------------------------------------------------- index maintenance


@query("select source, count(*) as n_sources, cast(sum(n_chars) as bigint) as n_chars from documents group by source")
def index_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_sources"), F.sum("n_chars").alias("n_chars"))


@query("select doc_id, sha256(text) as hash from documents where doc_id not in (select doc_id from labels where quality = 1)")
def incremental_changed(spark, d):
    now = index.source_hash(table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")).select("path", "hash")
    seen = table(spark, d, "labels").groupBy(F.col("doc_id").alias("path")).agg(F.max("quality").alias("quality"))
    old = now.join(seen, "path").select("path", F.when(F.col("quality") == 1, F.col("hash")).otherwise("stale").alias("hash"))
    return index.changed(now, old).select(F.col("path").alias("doc_id"), "hash")


@query("select doc_id, case when doc_id in (select doc_id from labels) then 'new' else 'old' end as version from documents")
def index_upsert(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("old").alias("version"))
    new = old.join(table(spark, d, "labels").select(F.col("doc_id").alias("path")), "path", "left_semi").withColumn("version", F.lit("new"))
    return index.upsert(old, new).select(F.col("path").alias("doc_id"), "version")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def dedupe_last(spark, d):
    return index.last_value(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def portable_retain(spark, d):
    return index.retained(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def portable_missing(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("select d.doc_id, e.label from documents d join embeddings e on e.vec_id = d.doc_id where len(e.embedding) = 64")
def portable_hit(spark, d):
    e = table(spark, d, "embeddings").filter(F.size("embedding") == 64).select(F.col("vec_id").alias("doc_id"), "label")
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id")


@query("select user_id as path, min(event_id) as first_id, max(event_id) as last_id, count(*) as attempts from events where event_type = 'error' group by user_id")
def failures_upsert(spark, d):
    log = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("path"), F.col("event_id").alias("ts"), F.col("event_type").alias("message"))
    return index.failures(log).select("path", F.col("first_failed_at").alias("first_id"), F.col("last_failed_at").alias("last_id"), "attempts")


@query("select distinct user_id as path from events where event_type = 'error' and user_id in (select user_id from events where event_type = 'signup')")
def failures_retryable(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'error'").select(F.col("user_id").alias("path")).distinct().join(e.filter("event_type = 'signup'").select(F.col("user_id").alias("path")), "path", "left_semi")


@query("select source, count_if(doc_id % 3 = 0) as n_pdf, count_if(doc_id % 3 <> 0) as n_markdown from documents group by source")
def resume_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("n_pdf"), F.count_if(F.col("doc_id") % 3 != 0).alias("n_markdown"))


# ---------------------------------------------------------------- change feed

_FEED = "f as (select event_id, ts, cast(user_id as varchar) as path, case event_type when 'error' then 'delete' when 'purchase' then 'rename' when 'signup' then 'create' else 'modify' end as kind from events)"


@query(
    f"with {_FEED}, g as (select *, case when ts - lag(ts) over (partition by path order by ts, event_id) < interval 1400 milliseconds then 0 else 1 end as fresh from f), "
    "s as (select *, sum(fresh) over (partition by path order by ts, event_id rows unbounded preceding) as burst from g) "
    "select path, arg_max(kind, (ts, event_id)) as kind, count(*) as n_events, epoch_us(max(ts)) as last_us from s group by path, burst"
)
def debounce_events(spark, d):
    return feed.debounced(feed.changes(table(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))).select("path", "kind", "n_events", F.unix_micros("last_ts").alias("last_us"))


@query(f"with {_FEED}, l as (select path, arg_max(kind, (ts, event_id)) as kind, count(*) as n_events from f group by path) select path, kind, n_events from l where kind <> 'delete'")
def cdc_apply(spark, d):
    return feed.final_state(feed.changes(table(spark, d, "events"))).filter("kind <> 'delete'")


# ---------------------------------------------------------------- name matching


@query("select p_partkey, lower(p_name) as name from part")
def normalize_source_name(spark, d):
    return table(spark, d, "part").select("p_partkey", N.normalize_name(F.concat("p_name", F.lit("_final.pdf"))).alias("name"))


@query("select p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 6) as similarity from part")
def edit_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(N.edit_similarity(F.lower("p_name"), F.lower("p_type"))).alias("similarity"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to chunks, BM25 for a question, the best chunks within the budget."""
    chunks = chunk.chunk_markdown(_sources(spark, d))
    best = search.bm25(_questions(spark, d), chunks.select(F.col("chunk_id").alias("id"), "content"), CFG.top_k)
    ranked = best.join(chunks.withColumnRenamed("chunk_id", "id"), "id").select("q_id", "rank", "id", "score", "path", "heading", "content")
    return context.budget(ranked, CFG.context_chunks, CFG.context_chars)


# ---------------------------------------------------------------- codec, maths, catalogue


@query("select vec_id, embedding from embeddings")
def f32_codec(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", codec.encode_f32("embedding").alias("encoded"))
    return e.select("vec_id", codec.decode_f32("encoded").alias("embedding"))


_PLAIN = "regexp_replace(coalesce(text, ''), '[\\\\`$~]', '', 'g')"


@query(f"select doc_id, sha256({_PLAIN} || chr(10) || 'a $x' || doc_id || '$ b $$y$$ `\\(c\\)` \\\\(d\\\\)' || chr(10) || '```' || chr(10) || '\\(e\\)' || chr(10) || '```' || chr(10) || '$f$' || {_PLAIN}) as text_sha256 from documents")
def math_delimiters(spark, d):
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\`$~]", "")
    made = F.concat(plain, F.lit("\na \\(x"), F.col("doc_id").cast("string"), F.lit("\\) b \\[y\\] `\\(c\\)` \\\\(d\\\\)\n```\n\\(e\\)\n```\n\\(f\\)"), plain)
    return table(spark, d, "documents").select("doc_id", made.alias("made")).select("doc_id", F.sha2(codec.normalize_math("made"), 256).alias("text_sha256"))

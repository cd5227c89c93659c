"""Queries of what goes into an answer and what is kept of it: histories, budgets, contexts, prompts and traces, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import MARKER
from ..operators import answer, citations, resolve, route
from ..sources.files import table
from . import resolution as R
from .registry import query

CFG = EngineConfig(chat_model="talker", lecture_model=" ")

_MARK = "chr(10) || chr(10) || '" + MARKER.strip("\n") + "' || chr(10)"


def _cut(x: str, most: str) -> str:
    room = f"({most} - {len(MARKER)})"
    head = f"cast(ceil({room} * 65 / 100.0) as bigint)"
    return f"case when length({x}) <= {most} then {x} else substr({x}, 1, {head}) || {_MARK} || right({x}, {room} - {head}) end"


# ---------------------------------------------------------------- histories


@query("with l as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations where role <> 'system') select conv_id, turn, role, sha256(coalesce(text, '')) as text_sha256 from l where back <= 4")
def chat_history(spark, d):
    rows = answer.generation_history(table(spark, d, "conversations").filter("role <> 'system'"), lecture=False)
    return rows.select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query(
    "with l as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations where role <> 'system' and turn % 3 < 2 qualify back <= 2), n as (select *, greatest(200, 700 // count(*) over (partition by conv_id)) as share from l) "
    f"select conv_id, turn, sha256(coalesce({_cut('text', 'share')}, '')) as cut_sha256 from n"
)
def generation_history(spark, d):
    rows = answer.generation_history(table(spark, d, "conversations").filter("role <> 'system' and turn % 3 < 2"), lecture=True, cfg=EngineConfig(history_chars=700))
    return rows.select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cut_sha256"))


_RQ = "p as (select p_partkey, p_name, p_size from part)"


@query(
    "with u as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) as back from conversations where role = 'user' qualify back <= 2), h as (select conv_id, string_agg(text, chr(10) order by turn) as h from u group by conv_id), "
    "q as (select distinct conv_id, 'question ' || conv_id as text, case when conv_id % 2 = 0 then 'f' || conv_id || '.pdf' end as file_name, case when conv_id % 3 = 0 then '1.' || (conv_id % 7) end as section from conversations) "
    "select q.conv_id, sha256(concat_ws(chr(10), h, q.text, 'Requested file: ' || file_name, 'Requested title: T' || case when file_name is not null then '' end, 'Requested path: d/' || file_name, 'Requested section: ' || section)) as query_sha256 from q left join h on h.conv_id = q.conv_id"
)
def retrieval_query(spark, d):
    c = table(spark, d, "conversations")
    i = F.col("conv_id")
    known = F.when(i % 2 == 0, F.concat(F.lit("f"), i.cast("string"), F.lit(".pdf")))
    asked = c.select("conv_id").distinct().select("conv_id", F.concat(F.lit("question "), i.cast("string")).alias("text"), known.alias("file_name"), F.lit("T").alias("title"), F.concat(F.lit("d/"), known).alias("path"), F.when(i % 3 == 0, F.concat(F.lit("1."), (i % 7).cast("string"))).alias("section"))
    return answer.retrieval_query(asked, c).select("conv_id", F.sha2("query", 256).alias("query_sha256"))


# ---------------------------------------------------------------- contexts

_RANKED = "r as (select lang as q_id, doc_id, coalesce(text, '') as content, row_number() over (partition by lang order by doc_id) as rank, count(*) over (partition by lang) as n from documents)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("q_id"), "doc_id", F.col("doc_id").alias("rank"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))


@query(
    f"with {_RANKED}, k as (select * from r where n <= 7 or (rank - 1) in (select floor(p * (n - 1) / 6.0 + 0.5) from range(7) t(p))), m as (select *, greatest(600, 5000 // count(*) over (partition by q_id)) as share from k) "
    f"select q_id, doc_id, sha256({_cut('content', 'share')}) as cut_sha256 from m"
)
def lecture_budget(spark, d):
    cfg = EngineConfig(lecture_chunks=7, lecture_chars=5_000)
    some = answer.even_sample(_ranked(spark, d), cfg.lecture_chunk_limit).join(_texts(spark, d), "doc_id")
    return answer.lecture_chunks(some, cfg).select("q_id", "doc_id", F.sha2("content", 256).alias("cut_sha256"))


_KINDS = "case when doc_id % 2 = 0 then 'pdf' else 'markdown' end"


@query(
    f"with {_RANKED}, b as (select q_id, rank, content, '[SOURCE ' || rank || ']' || chr(10) || 'File: ' || q_id || '/' || doc_id || chr(10) || 'Type: ' || {_KINDS} || chr(10) || 'Title: ' || chr(10) || 'Heading: Document' || chr(10) || case when doc_id % 3 = 0 then 'Section number: ' || (doc_id % 5) || '.1' || chr(10) || case when doc_id % 6 = 0 then 'Section title: Sets' || chr(10) else '' end else '' end "
    "|| case when doc_id % 2 = 0 and doc_id % 7 > 0 then case when doc_id % 4 = 0 then 'PDF page: ' || (doc_id % 7) else 'PDF pages: ' || (doc_id % 7) || '-' || (doc_id % 7 + 1) end || chr(10) else '' end || 'Tags: ' || case when doc_id % 5 = 0 then 'a, b' else '(none)' end || chr(10) || chr(10) || content as block from r where rank <= 6) "
    "select q_id, count(*) as n_chunks, cast(sum(length(content)) as bigint) as n_chars, sha256(string_agg(block, chr(10) || chr(10) || '------------------------------' || chr(10) || chr(10) order by rank)) as context_sha256 from b group by q_id"
)
def source_context(spark, d):
    i = F.col("doc_id")
    first = _ranked(spark, d).withColumn("n", F.row_number().over(W.partitionBy("q_id").orderBy("rank"))).filter("n <= 6").join(_texts(spark, d), "doc_id")
    hits = first.select(
        "q_id", "rank", F.concat("q_id", F.lit("/"), i.cast("string")).alias("file_path"), F.when(i % 2 == 0, "pdf").alias("source_type"), F.lit("Document").alias("heading"), F.when(i % 3 == 0, F.concat((i % 5).cast("string"), F.lit(".1"))).alias("section_number"),
        F.when(i % 6 == 0, "Sets").alias("section_title"), (i % 7).alias("page_start"), F.when(i % 4 == 0, i % 7).otherwise(i % 7 + 1).alias("page_end"), F.when(i % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), "content",
    )
    return answer.source_context(citations.retrieved(hits)).select("q_id", "n_chunks", "n_chars", F.sha2("context", 256).alias("context_sha256"))


@query("select doc_id, cast(doc_id as varchar) as id, '' as title, coalesce(lang, '') as heading, case when doc_id % 2 = 0 then 'pdf' else 'markdown' end as source_type, 0 as page_start, case when doc_id % 3 = 0 then 0.0::double else doc_id / 2 end as score, []::varchar[] as tags from documents")
def retrieved_defaults(spark, d):
    i = F.col("doc_id")
    hits = table(spark, d, "documents").select(i.cast("string").alias("id"), F.when(F.col("lang") != "", F.col("lang")).alias("heading"), F.when(i % 2 == 0, "pdf").otherwise("docx").alias("source_type"), F.when(i % 3 > 0, i / 2).alias("score"), F.lit(None).cast("int").alias("page_start"))
    return citations.retrieved(hits).select(F.col("id").cast("long").alias("doc_id"), "id", "title", "heading", "source_type", "page_start", "score", "tags")


@query("select user_id as q_id, 's' || (event_id % 7) as path, min(event_id) as rank from events group by user_id, event_id % 7")
def distinct_candidates(spark, d):
    from ..operators.search import distinct_sources

    hits = table(spark, d, "events").select(F.col("user_id").alias("q_id"), F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")).alias("path"), F.col("event_id").alias("rank"))
    return distinct_sources(hits)


# ---------------------------------------------------------------- prompts, traces, turns


@query(f"with {R._ALL_ASKS} select q_id, case when {R._LECTURE_SQL} then 'lecture' else 'chat' end as mode, 'talker' as model from asks")
def generation_profile(spark, d):
    """No lecture model is set here, so the chat model serves both."""
    lecture = R.phrases.is_lecture_request(F.col("text"))
    return R.questions(spark, d, 1).select("q_id", answer.generation_profile(lecture, CFG).alias("p")).select("q_id", "p.*")


_RULES = "'" + f"{answer.RULES}\n{answer.ONLY_SOURCES}".replace("\n", "' || chr(10) || '") + "'"


@query(
    f"with {R._ASKED}, c as (select b.q_id, string_agg(ex.title, ', ' order by rank) as context from b join ex on ex.q_id = b.q_id group by b.q_id) "
    f"select c.q_id, sha256({_RULES} || case when lecture then chr(10) || '{answer.LECTURE_RULES}' else '' end || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || text) as answer_sha256 from c join b on b.q_id = c.q_id"
)
def section_answers(spark, d):
    """Questions for a section of a source, answered with their prompts: only those whose section is indexed."""
    q = R.questions(spark, d)
    resolved = resolve.resolve(q, R.library(spark, d))
    routed = route.route(q, resolved, R.chunks(spark, d)).join(q, "q_id")
    hits = route.exact_section(routed.filter("mode = 'section' and path is not null").select("q_id", "path", "section"), R.chunks(spark, d))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])
    context = hits.groupBy("q_id").agg(F.array_join(listed, ", ").alias("context"))
    return answer.PromptOnly().answer(answer.prompts(routed, context)).select("q_id", F.sha2("answer", 256).alias("answer_sha256"))


@query(
    f"with {R._ASKED}, sg as (select q_id, list(regexp_extract(path, '[^/]+$') || ' (' || cast(floor(score + 0.5) as int) || '%)' order by rank) as s from (select q_id, path, score, row_number() over (partition by q_id order by score desc, path) as rank from scored where score >= 35 qualify rank <= 3) z group by q_id) "
    "select b.q_id, case when section is not null then 'section' when path is not null then 'source' else 'hybrid' end as mode, path, section, (select count(*) from ex where ex.q_id = b.q_id) as n_chunks, case when section is not null and path is null then coalesce(sg.s, []) else [] end as suggestions from b left join sg on sg.q_id = b.q_id"
)
def retrieval_trace(spark, d):
    q = R.questions(spark, d)
    library, chunks = R.library(spark, d), R.chunks(spark, d)
    routed = route.route(q, resolve.resolve(q, library), chunks)
    hits = route.exact_section(routed.filter("mode = 'section' and path is not null").select("q_id", "path", "section"), chunks)
    contexts = hits.groupBy("q_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("title")).alias("n_chars"))
    return answer.retrieval_trace(routed, contexts, resolve.suggest(q, library)).select("q_id", "mode", "path", "section", "n_chunks", "suggestions")


@query(
    "with t as (select conv_id, turn, 'q' || turn as question, case when turn % 3 > 0 then 'a' || turn end as answer, case turn % 3 when 0 then 'error' when 1 then 'complete' else 'stopped' end as state from conversations) "
    "select conv_id, turn * 2 as turn, 'user' as role, question as text, state as request_state from t union all select conv_id, turn * 2 + 1, 'assistant', case when state = 'error' then 'failed ' || turn else coalesce(answer, '') end, state from t"
)
def turns_kept(spark, d):
    t = F.col("turn")
    text = lambda mark: F.concat(F.lit(mark), t.cast("string"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", text("q").alias("question"), F.when(t % 3 > 0, text("a")).alias("answer"), F.when(t % 3 == 0, "error").when(t % 3 == 1, "complete").otherwise("stopped").alias("state"), text("failed ").alias("failure"))
    return answer.kept_turns(turns)

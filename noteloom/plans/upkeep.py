"""Queries of metadata, failures, rebuilds, portable entries, change feeds and small scalar functions, each with SQL. Inputs are made from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import values as V
from ..functions.text import strip_frontmatter
from ..operators import catalog, embed, index
from ..sources.files import table
from ..streaming import events as feed
from .registry import query


def s(x: Column) -> Column:
    return x.cast("string")


# ---------------------------------------------------------------- metadata

_NOTE_SQL = "'---' || chr(10) || 'tags: [#one, \"x' || (doc_id % 3) || '\", a/b]' || chr(10) || 'up: \"[[Home ' || (doc_id % 4) || ']]\"' || chr(10) || '---' || chr(10)"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with a frontmatter, the text without signs of the grammar, and tags and links after it."""
    i = F.col("doc_id")
    head = F.concat(F.lit('---\ntags: [#one, "x'), s(i % 3), F.lit('", a/b]\nup: "[[Home '), s(i % 4), F.lit(']]"\n---\n'))
    tail = F.concat(F.lit("\n#one #t"), s(i % 5), F.lit(" x#no\n```\n#code [[Code]]\n```\n[[A "), s(i % 7), F.lit("|alias]] ![[pic"), s(i % 2), F.lit(".png]] [m](n"), s(i % 3), F.lit(".md) [[A "), s(i % 7), F.lit("#part]]\n"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[#\[\]()`~]", "")
    return table(spark, d, "documents").select("doc_id", F.concat(head, plain, tail).alias("text")).withColumn("body", strip_frontmatter(F.col("text")))


@query("select doc_id, list_distinct(['one', 'x' || (doc_id % 3), 'a/b', 't' || (doc_id % 5)]).list_sort() as tags from documents")
def meta_tags(spark, d):
    return _notes(spark, d).select("doc_id", F.array_sort(M.tags(F.col("text"), F.col("body"))).alias("tags"))


@query("select doc_id, ['A ' || (doc_id % 7), 'n' || (doc_id % 3) || '.md', 'pic' || (doc_id % 2) || '.png', 'Home ' || (doc_id % 4)] as links from documents")
def meta_links(spark, d):
    return _notes(spark, d).select("doc_id", M.links(F.col("text"), F.col("body")).alias("links"))


@query(
    "select p_partkey, list_filter(['name=' || p_name, 'size=' || p_size, 'kinds=' || p_type, 'kinds=' || lower(p_type), 'kinds.deep.at=' || p_size, 'on=' || case when p_size % 2 = 0 then 'true' else 'false' end, case when p_size % 3 > 0 then 'inner.brand=' || p_brand end], lambda x: x is not null) as properties from part"
)
def meta_props(spark, d):
    brand = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise("null")
    text = F.format_string(
        '{"name": "%s", "position": {"line": 3}, "size": %d, "kinds": ["%s", ["%s", {"deep": [{"at": %d}]}], null], "on": %s, "inner": {"brand": %s}, "none": null}',
        "p_name", "p_size", "p_type", F.lower("p_type"), "p_size", F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), brand,
    )
    return table(spark, d, "part").select("p_partkey", M.properties(text).alias("properties"))


# ---------------------------------------------------------------- failures

_MESSAGE_SQL = "case event_id % 7 when 0 then 'File system operation timed out. (attempt ' || (event_id % 4 + 1) || ' of 4)' when 1 then 'EBUSY: resource busy or locked' when 2 then 'ENOENT: no such file' when 3 then 'No text (ATTEMPT 2 OF 4)' when 4 then 'Resource temporarily unavailable' when 5 then '' end"
_LOG_SQL = f"log as (select event_id, cast(user_id as varchar) || case user_id % 3 when 0 then '.md' when 1 then '.PDF' else '.txt' end as path, event_id as ts, {_MESSAGE_SQL} as message from events where event_type = 'error')"
_ATTEMPTS_SQL = "greatest(1, coalesce(try_cast(nullif(regexp_extract({0}, '(?i)\\(attempt\\s+(\\d+)\\s+of\\s+\\d+\\)', 1), '') as int), 1))"


def _message() -> Column:
    i = F.col("event_id")
    kinds = [F.concat(F.lit("File system operation timed out. (attempt "), s(i % 4 + 1), F.lit(" of 4)")), F.lit("EBUSY: resource busy or locked"), F.lit("ENOENT: no such file"), F.lit("No text (ATTEMPT 2 OF 4)"), F.lit("Resource temporarily unavailable"), F.lit(""), F.lit(None).cast("string")]
    return F.get(F.array(*kinds), (i % 7).cast("int"))


def _path() -> Column:
    return F.concat(s(F.col("user_id")), F.get(F.array(F.lit(".md"), F.lit(".PDF"), F.lit(".txt")), (F.col("user_id") % 3).cast("int")))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", _path().alias("path"), F.col("event_id").alias("ts"), _message().alias("message"))


@query(f"select event_id, event_id % 7 in (0, 1, 4) as passing, {_ATTEMPTS_SQL.format(_MESSAGE_SQL)} as attempts from events")
def retryable_errors(spark, d):
    rows = table(spark, d, "events").select("event_id", _message().alias("message"))
    return rows.select("event_id", V.is_passing_error(F.col("message")).alias("passing"), V.attempts(F.col("message")).alias("attempts"))


@query(
    f"with {_LOG_SQL}, e as (select * from log where path not in (select path from log where event_id % 5 = 0 and event_id >= 100)), "
    f"l as (select path, min(ts) as first_failed_at, max(ts) as last_failed_at, arg_max(coalesce(message, ''), ts) as message from e group by path) select path, first_failed_at, last_failed_at, cast({_ATTEMPTS_SQL.format('message')} as int) as attempts, row_number() over (order by last_failed_at desc, path) as place from l qualify place <= 100"
)
def failures_recorded(spark, d):
    """The 100 newest failures of two runs recorded one after the other, without those of paths that were indexed since."""
    log = _log(spark, d).withColumn("message", F.coalesce("message", F.lit("")))
    old, new = log.filter("event_id % 2 = 0"), log.filter("event_id % 2 = 1")
    none = index.failures(log.limit(0)).withColumn("attempts", F.col("attempts").cast("int"))
    both = index.record(index.record(none, old), new)
    left = index.cleared(both, log.filter("event_id % 5 = 0 and event_id >= 100"))
    order = F.row_number().over(index.W.orderBy(F.col("last_failed_at").desc(), "path"))  # over 100 rows
    return index.by_last_failure(left).limit(100).select("path", "first_failed_at", "last_failed_at", "attempts", order.cast("long").alias("place"))


@query(
    f"with {_LOG_SQL}, t as (select path, max(message) as error from log where event_id % 3 = 0 group by path), src as (select distinct cast(user_id as varchar) || case user_id % 3 when 0 then '.md' when 1 then '.PDF' else '.txt' end as path from events where user_id % 5 > 0) "
    "select a.path, case when s.path is null then 'missing' when a.path like '%.txt' then 'not-indexable' when t.error is not null then 'failed' else 'success' end as outcome from (select distinct path from log) a left join src s on s.path = a.path left join t on t.path = a.path"
)
def retry_outcomes(spark, d):
    log = _log(spark, d)
    sources = table(spark, d, "events").filter("user_id % 5 > 0").select(_path().alias("path"))
    return index.retry_outcomes(log, sources, log.filter("event_id % 3 = 0").select("path", F.col("message").alias("error")))


# ---------------------------------------------------------------- rebuilds


@query("select doc_id from documents where doc_id % 4 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0")
def resume_pending(spark, d):
    i = F.col("doc_id")
    files = index.source_hash(table(spark, d, "documents").select("doc_id", F.concat(s(i), F.when(i % 2 == 0, ".pdf").otherwise(".md")).alias("path"), "text"))
    saved = files.filter("doc_id % 4 > 0").withColumn("hash", F.when(i % 5 == 0, "other").otherwise(F.col("hash"))).withColumn("source_type", F.when((i % 2 == 0) != (i % 7 == 0), "pdf").otherwise("markdown"))
    return index.pending(files, saved).select("doc_id")


@query("select event_id as run, event_id % 2 = 0 and event_id % 3 > 0 and event_id % 5 > 0 and event_id % 7 > 0 and event_id % 11 > 0 as resumes from events")
def rebuild_resumes(spark, d):
    i, now = F.col("event_id"), {"index_version": F.lit(7), "provider": F.lit("local"), "identity": F.lit("m"), "dimensions": F.lit(64), "index_pdf": F.lit(True)}
    other = {"c_index_version": F.when(i % 3 > 0, 7).otherwise(6), "m_dimensions": F.when(i % 5 > 0, 64), "c_provider": F.when(i % 7 > 0, "local").otherwise("remote"), "m_index_pdf": i % 11 > 0}
    sides = {f"{side}_{p}": other.get(f"{side}_{p}", now[p]) for side in "cm" for p in index.PROFILE}
    runs = table(spark, d, "events").select(i.alias("run"), (i % 2 == 0).alias("snapshot_saved"), *[c.alias(n) for n, c in sides.items()])
    return index.can_resume(runs, spark.range(1).select(*[c.alias(n) for n, c in now.items()]))


@query("select p_partkey, case when p_size % 2 = 0 then 'rebuild: version' when p_size % 3 = 0 then 'rebuild: provider' when p_size % 5 = 0 then 'rebuild: identity' when p_size % 7 = 0 then 'rebuild: dimensions' when p_size % 11 = 0 then 'rebuild: pdf' else 'ready' end as status from part")
def profile_status(spark, d):
    z = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.when(z % 2 == 0, 6).otherwise(7).alias("index_version"), F.when(z % 3 == 0, "remote").otherwise("local").alias("provider"), F.when(z % 5 == 0, "n").otherwise("m").alias("identity"), F.when(z % 7 == 0, 32).otherwise(64).alias("dimensions"), (z % 11 > 0).alias("index_pdf"))
    return index.profile_status(rows, 7, "local", "m", 64, True).select("p_partkey", "status")


@query("select 'ready' as state, n_sources || ' sources, ' || n_chunks || ' chunks' as message, n_sources, n_chunks from (select count(*) as n_sources, cast(sum(n_chars // 1000 + 1) as bigint) as n_chunks from documents) z")
def status_snapshot(spark, d):
    counts = table(spark, d, "documents").agg(F.count("*").alias("n_sources"), F.sum(F.floor(F.col("n_chars") / 1000) + 1).alias("n_chunks"))
    return index.status(counts, profile_ok=True, busy=False)


# ---------------------------------------------------------------- portable entries

_PORTABLE = "vec_id % 13 = 5 or vec_id % 11 = 3 or vec_id % 7 = 2 or vec_id % 5 = 4"


@query(f"select vec_id from embeddings where not ({_PORTABLE})")
def portable_valid(spark, d):
    """Entries whose hash differs, whose object is of another path, whose vectors are cut, or whose chunks are too few are no hits."""
    i = F.col("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", s(i).alias("path"), "embedding")
    wanted = e.select("path", F.concat(F.lit("h"), "path").alias("hash"))
    entries = e.select("path", F.concat(F.when(i % 13 == 5, "x").otherwise("h"), "path").alias("hash"), F.concat(F.lit("a"), "path").alias("address"), F.when(i % 5 == 4, 3).otherwise(2).alias("n_chunks"))
    objects = e.select(F.concat(F.lit("a"), "path").alias("address"), F.when(i % 11 == 3, "other").otherwise(F.col("path")).alias("path"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.when(i % 7 == 2, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("vector"))
    return index.portable_hits(wanted, entries, objects, 64).select(F.col("path").cast("long").alias("vec_id"))


@query("select sha256(text) as address from documents group by text having bool_and(coalesce(doc_id, 0) not in (select doc_id from labels)) and sha256(text) not in (select sha256(text) from documents where doc_id in (select doc_id from labels))")
def portable_new_objects(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("address"))
    stored = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("address").distinct()
    return index.absent(docs, stored).select("address")


@query("select d.doc_id, case when e.vec_id is not null and d.doc_id % 3 > 0 then e.label else -1 end as origin from documents d left join embeddings e on e.vec_id = d.doc_id")
def vectors_reused(spark, d):
    docs = table(spark, d, "documents").select("doc_id", s(F.col("doc_id")).alias("path"), F.concat(F.lit("h"), s(F.col("doc_id"))).alias("hash"), F.lit("markdown").alias("source_type"))
    stored = table(spark, d, "embeddings").select(s(F.col("vec_id")).alias("path"), F.concat(F.lit("h"), s(F.col("vec_id"))).alias("hash"), F.when(F.col("vec_id") % 3 > 0, "markdown").otherwise("pdf").alias("source_type"), F.array(F.col("label").cast("float")).alias("vector"))
    out = index.reused(docs, stored, lambda rest: rest.withColumn("vector", F.array(F.lit(-1.0).cast("float"))))
    return out.select("doc_id", F.col("vector")[0].cast("int").alias("origin"))


# ---------------------------------------------------------------- change feeds

_RENAMES = "f as (select event_id, ts, 'p' || user_id as path, 'p' || (user_id + 1) as old_path, case event_type when 'error' then 'delete' when 'purchase' then 'rename' when 'signup' then 'create' else 'modify' end as kind from events), st as (select path, case when kind = 'delete' then 'delete' else 'upsert' end as kind, ts, event_id, 1 as step from f union all select old_path, 'delete', ts, event_id, 0 from f where kind = 'rename')"


def _feed(spark: SparkSession, d: str) -> DataFrame:
    e = feed.changes(table(spark, d, "events"))
    number = F.col("path").cast("long")
    return e.select("event_id", "ts", "kind", F.concat(F.lit("p"), s(number)).alias("path"), F.concat(F.lit("p"), s(number + 1)).alias("old_path"))


@query(f"with {_RENAMES} select path, kind, event_id, step from st")
def rename_steps(spark, d):
    return feed.steps(_feed(spark, d)).select("path", "kind", "event_id", "step")


@query(
    f"with {_RENAMES}, l as (select path, arg_max(kind, (ts, event_id, step)) as kind from st group by path), idx as (select distinct 'p' || doc_id as path, 'old' as version from documents where doc_id % 3 > 0), src as (select 'p' || doc_id as path from documents where doc_id % 5 > 0), "
    "up as (select src.path from src join l on l.path = src.path where l.kind = 'upsert' and cast(substr(src.path, 2) as bigint) % 4 > 0) "
    "select path, version from idx where path not in (select path from l where kind = 'delete') and path not in (select path from up) union all select path, 'new' from up"
)
def cdc_index(spark, d):
    """An index after a feed: deleted paths go, changed ones are prepared again unless their hash is known."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), s(F.col("doc_id"))).alias("path"))
    before = docs.filter("doc_id % 3 > 0").select("path", F.lit("old").alias("version"))
    sources = docs.filter("doc_id % 5 > 0").select("path", F.concat(F.lit("h"), "path").alias("hash"))
    manifest = docs.select("path", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("h"), "path")).otherwise("stale").alias("hash"))
    return feed.apply_steps(before, feed.steps(_feed(spark, d)), manifest, sources, lambda fresh: fresh.select("path", F.lit("new").alias("version")))


@query(
    "select conv_id as q_id, string_agg(case when turn % 4 = 1 then 'hm ' else '' end, '' order by turn) as thinking, string_agg('t' || turn || ' ', '' order by turn) as answer, max(turn) % 2 = 1 as done, case when max(turn) % 2 = 1 then max(turn) end as answer_tokens, case when max(turn) % 2 = 1 then cast(max(turn) * 1.5 as double) end as total_ms from conversations group by conv_id"
)
def token_streams(spark, d):
    t = F.col("turn")
    last = F.max("turn").over(index.W.partitionBy("conv_id"))
    c = table(spark, d, "conversations").select("conv_id", "turn").withColumn("end", (t == last) & (t % 2 == 1))
    line = F.concat(F.lit('{"message": {"content": "t'), s(t), F.lit(' "'), F.when(t % 4 == 1, ', "thinking": "hm "').otherwise(""), F.lit("}, "), F.when(F.col("end"), F.concat(F.lit('"done": true, "eval_count": '), s(t), F.lit(', "total_duration": '), s(t * 1_500_000))).otherwise('"done": false'), F.lit("}"))
    broken = F.explode(F.array(F.struct(t.alias("seq"), line.alias("line")), F.struct((t * 1000 + 7).alias("seq"), F.lit("{not json").alias("line"))))
    got = feed.token_stream(c.select(F.col("conv_id").alias("q_id"), broken.alias("x")).select("q_id", "x.*"))
    return got.select("q_id", "thinking", "answer", "done", "answer_tokens", "total_ms")


# ---------------------------------------------------------------- scalars


@query(
    "select event_id, printf('%.1fs', greatest(0, value * 37 - 99) / 1000) as stage, case when s >= 3600 then lpad(cast(s // 3600 as varchar), 2, '0') || ':' else '' end || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as elapsed, round(greatest(0, (value - 20) / 1000000), 9) as ms from (select *, event_id * 61 % 9000 as s from events) z"
)
def durations(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", V.stage_duration(v * 37 - 99).alias("stage"), V.elapsed(F.col("event_id") * 61 % 9000 * 1000 + 999).alias("elapsed"), F.round(V.milliseconds(v - 20), 9).alias("ms"))


@query(
    "select p_partkey, cast(greatest(1, least(4, p_size // 10)) as bigint) as workers, cast(case when p_size > 1 then p_size - 1 end as bigint) as positive, cast(case when p_size % 5 = 0 then 8 else greatest(1, least(12, p_size)) end as bigint) as chunks, cast(case when p_size < 25 then 2000 else least(12000, (p_size - 25) * 1000) end as bigint) as history, cast(case when p_size % 4 = 0 then 2 else 1 end as bigint) as otherwise from part"
)
def numeric_clamps(spark, d):
    z = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", V.clamp_integer(z / 10, 1, 4, 2).alias("workers"), V.positive_integer(z - 0.5).alias("positive"), V.configured(F.when(z % 5 == 0, -3.5).otherwise(z + 0.9), 1, 12, 8).alias("chunks"),
        V.configured(F.when(z < 25, -1.0).otherwise((z - 25) * 1000 + 0.5), 0, 12_000, 2_000, zero=True).alias("history"), V.clamp_integer(F.when(z % 4 == 0, float("nan")).otherwise(0.0), 1, 4, 2).alias("otherwise"),
    )


@query("select p_partkey, p_size % 3 <> 1 as same from part")
def model_names_match(spark, d):
    name, k = F.lower("p_type"), F.col("p_size") % 3
    a = F.when(k == 0, F.concat(name, F.lit(":latest"))).otherwise(name)
    b = F.when(k == 1, F.concat(name, F.lit(":7b"))).otherwise(name)
    return table(spark, d, "part").select("p_partkey", V.model_names_match(a, b).alias("same"))


@query("select p_partkey, case when p_size % 5 < 2 then p_name end as title, case when p_size % 5 < 2 then p_size end as minutes, case when p_size % 5 < 2 then 2 end as n_slides from part")
def lecture_answers(spark, d):
    z = F.col("p_size")
    whole = F.format_string('{"title": "%s", "audience": "all", "durationMinutes": %d, "slides": [{"t": 1}, {"t": 2}]}', "p_name", "p_size")
    answer = F.when(z % 5 == 0, whole).when(z % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(z % 5 == 2, F.replace(whole, F.lit('"all"'), F.lit("7"))).when(z % 5 == 3, F.replace(whole, F.lit("slides"), F.lit("pages"))).otherwise("{broken")
    got = table(spark, d, "part").select("p_partkey", V.lecture(answer).alias("l"))
    return got.select("p_partkey", "l.title", F.col("l.durationMinutes").cast("int").alias("minutes"), F.when(F.col("l").isNotNull(), F.size("l.slides")).alias("n_slides"))


@query("select p_partkey, case p_size % 3 when 0 then 'TypeError: ' else '' end || case when p_size % 2 = 0 then p_name else 'The request failed.' end as error, case when p_size % 4 = 0 then p_name || ' — 7B · embedding' when p_size % 4 = 1 then p_name || ' — Q4' else p_name end as label from part")
def error_texts(spark, d):
    z = F.col("p_size")
    name = F.when(z % 3 == 0, "TypeError").when(z % 3 == 1, "Error")
    can = F.when(z % 4 == 0, F.array(F.lit("completion"), F.lit("embedding")))
    label = V.model_label(F.col("p_name"), F.when(z % 4 == 0, "7B").otherwise(""), F.when(z % 4 == 1, "Q4"), can)
    return table(spark, d, "part").select("p_partkey", V.error_text(name, F.when(z % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(" \t")).alias("error"), label.alias("label"))


@query(
    "with m as (select distinct 'M' || p_size || '-' || lower(p_type) as name, 'm' || lpad(cast(p_size as varchar), 20, '0') || '-' || lower(p_type) as key, p_size % 3 as k from part), c as (select 'generation' as purpose, * from m where k in (0, 2) union all select 'embedding', * from m where k in (1, 2)) "
    "select purpose, name, cast(row_number() over (partition by purpose order by k = 2, key, name) - 1 as int) as place from c"
)
def model_catalog(spark, d):
    z = F.col("p_size")
    can = F.when(z % 3 == 0, F.array(F.lit("completion"), F.lit("tools"))).when(z % 3 == 1, F.array(F.lit("embedding")))
    models = table(spark, d, "part").select(F.concat(F.lit("M"), s(z), F.lit("-"), F.lower("p_type")).alias("name"), can.alias("capabilities"))
    both = [catalog.models_for(models, p).select(F.lit(p).alias("purpose"), "name", "place") for p in ("generation", "embedding")]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- vectors


@query(
    "with p as (select label, unnest(range(1, 65)) as i, unnest(embedding) as x from embeddings), m as (select label, i, avg(cast(x as double)) as x from p group by label, i), n as (select label, sqrt(sum(x * x)) as norm from m group by label) select m.label, cast(i as int) as i, round(x / norm, 6) as x from m join n on n.label = m.label"
)
def mean_pooled(spark, d):
    pooled = embed.mean_pooled(table(spark, d, "embeddings"), "label", "embedding", 64)
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query()
def embed_chunks(spark, d):
    """Vectors of whole texts by the model without weights; tests hold them against a plain loop."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    return embed.embedded(rows, embed.HashedEmbedder()).select("doc_id", "embedding")

"""Change feeds: debounced per path, in batch and as a stream, and their application to an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..functions.values import milliseconds


def changes(events: DataFrame) -> DataFrame:
    """The events table as a change feed: path, kind, ts, event_id. errors delete, purchases rename, the rest index."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "signup", "create").otherwise("modify")
    return events.select("event_id", "ts", F.col("user_id").cast("string").alias("path"), kind.alias("kind"))


def steps(feed: DataFrame) -> DataFrame:
    """A feed (path, old_path of renames, kind, ts, event_id) as deletions and upserts: path, kind, ts, event_id, step. A rename deletes the old path, then indexes the new one."""
    kind = F.when(F.col("kind") == "delete", "delete").otherwise("upsert")
    own = F.struct("path", kind.alias("kind"), F.lit(1).alias("step"))
    gone = F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("kind"), F.lit(0).alias("step"))
    each = F.when(F.col("kind") == "rename", F.array(gone, own)).otherwise(F.array(own))
    return feed.select("ts", "event_id", F.explode(each).alias("s")).select("s.path", "s.kind", "ts", "event_id", "s.step")


def last_steps(steps_: DataFrame) -> DataFrame:
    """The last step of each path, whatever the order of rows: path, kind."""
    return steps_.groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id", "step")).alias("kind"))


def apply_steps(index: DataFrame, steps_: DataFrame, manifest: DataFrame, sources: DataFrame, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index (path, ...) after a feed's steps. Deleted paths go. Of upserted ones only sources (path, hash, ...) whose hash the manifest (path, hash) lacks are prepared again,
    by ``prepare`` (sources to index rows), and replace what was there; others, and those whose source is missing, stay as they are."""
    last = last_steps(steps_)
    fresh = sources.join(last.filter("kind = 'upsert'").select("path"), "path", "left_semi").join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")
    out = index.join(last.filter("kind = 'delete'").select("path").unionByName(fresh.select("path")).distinct(), "path", "left_anti")
    return out.unionByName(prepare(fresh))


def token_stream(lines: DataFrame) -> DataFrame:
    """Answers that arrive as JSON lines (q_id, seq, line) put together: q_id, thinking, answer, done, and of the last line prompt_tokens, answer_tokens, total_ms, eval_ms. Lines that are no JSON object are left out.
    The lines of one answer are gathered, as they are its result."""
    schema = "message struct<content:string,thinking:string>, done boolean, prompt_eval_count long, eval_count long, total_duration double, eval_duration double"
    parsed = lines.select("q_id", "seq", F.from_json("line", schema).alias("x")).filter("x is not null and (x.message is not null or x.done is not null)")
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce(F.col(f"x.message.{c}"), F.lit("")).alias("t")))), lambda p: p["t"]), "")
    last = F.max_by("x", F.when(F.col("x.done"), F.col("seq")))
    rows = parsed.groupBy("q_id").agg(told("thinking").alias("thinking"), told("content").alias("answer"), F.coalesce(F.bool_or("x.done"), F.lit(False)).alias("done"), last.alias("l"))
    return rows.select("q_id", "thinking", "answer", "done", F.col("l.prompt_eval_count").alias("prompt_tokens"), F.col("l.eval_count").alias("answer_tokens"), milliseconds(F.col("l.total_duration")).alias("total_ms"), milliseconds(F.col("l.eval_duration")).alias("eval_ms"))


def debounced(feed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row per burst of a path's events, with the last event's kind."""
    return (
        feed.groupBy("path", F.session_window("ts", f"{cfg.debounce_ms} milliseconds").alias("w"))
        .agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))
        .select("path", "kind", "n_events", "last_ts")
    )


def final_state(feed: DataFrame) -> DataFrame:
    """The last change of each path by (ts, event_id)."""
    return feed.groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n_events"))


def run_stream(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "10 minutes", cfg: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Debounces a streaming feed and hands each micro-batch to ``apply``, at most one in ``persist_ms``."""
    return debounced(feed.withWatermark("ts", watermark), cfg).writeStream.outputMode("append").trigger(processingTime=f"{cfg.persist_ms} milliseconds").option("checkpointLocation", checkpoint).foreachBatch(apply).start()

"""From chosen chunks to an answer: prompts, histories, retrieval queries, traces, and the turns that are kept."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import truncate_to
from .context import even_sample

#: Messages that go along with a question, and the least room for a message and a chunk.
CHAT_MESSAGES, LECTURE_MESSAGES, LEAST_MESSAGE, LEAST_CHUNK = 4, 2, 200, 600

RULES = "You answer questions about a collection of notes and books. Cite the sources that you use by their numbers."
ONLY_SOURCES = "Use nothing but the sources below. If they do not hold the answer, say so."
SOURCES_FIRST = "Prefer the sources below. Where you add what you know yourself, say that it comes from elsewhere."
LECTURE_RULES = "Write a lecture slide by slide: a title, a few points and speaker notes for each slide, and the numbers of the sources they rest on."


def system_prompt(lecture: Column, only_sources: bool) -> Column:
    told = f"{RULES}\n{ONLY_SOURCES if only_sources else SOURCES_FIRST}"
    return F.when(lecture, f"{told}\n{LECTURE_RULES}").otherwise(told)


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Sources:\n\n"), F.when(F.coalesce(context, F.lit("")) == "", "(none)").otherwise(context), F.lit("\n\nQuestion:\n"), question)


def source_block(number: Column) -> Column:
    """A numbered block of a retrieved row: path, type, title, heading, section, pages, tags, and the content."""
    first, last = F.col("page_start").cast("string"), F.col("page_end").cast("string")
    numbered, paged = F.col("section_number") != "", (F.col("source_type") == "pdf") & (F.col("page_start") > 0)
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    head = [
        F.concat(F.lit("[SOURCE "), number.cast("string"), F.lit("]")), line("File", F.col("file_path")), line("Type", F.col("source_type")), line("Title", F.col("title")), line("Heading", F.col("heading")),
        F.when(numbered, line("Section number", F.col("section_number"))), F.when(numbered & (F.col("section_title") != ""), line("Section title", F.col("section_title"))),
        F.when(paged & (first == last), line("PDF page", first)), F.when(paged & (first != last), line("PDF pages", F.concat(first, F.lit("-"), last))),
        line("Tags", F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("(none)")),
    ]
    return F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), F.col("content"))


def source_context(kept: DataFrame) -> DataFrame:
    """kept (q_id, rank and a retrieved row's columns) to q_id, context, n_chunks, n_chars. Blocks are numbered by rank; a question's chunks are few, as they are within its budget."""
    n = F.row_number().over(W.partitionBy("q_id").orderBy("rank"))
    blocks = kept.withColumn("n", n).select("q_id", "n", source_block(F.col("n")).alias("b"), F.length("content").alias("chars"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"])
    return blocks.groupBy("q_id").agg(F.array_join(listed, "\n\n" + "-" * 30 + "\n\n").alias("context"), F.count("*").alias("n_chunks"), F.sum("chars").alias("n_chars"))


def lecture_chunks(ranked: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """ranked (q_id, rank, content): evenly spaced chunks, each cut to its share of the characters, 600 at least."""
    some = even_sample(ranked, cfg.lecture_chunk_limit)
    share = F.greatest(F.lit(LEAST_CHUNK), F.floor(F.lit(cfg.lecture_char_limit) / F.count("*").over(W.partitionBy("q_id"))))
    return some.withColumn("content", truncate_to(F.col("content"), share.cast("int")))


def generation_history(messages: DataFrame, lecture: bool, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """messages (conv_id, turn, role, text) that go along with a question: the last four; of a lecture the last two, each cut to its share of the history's characters, 200 at least."""
    if lecture and cfg.history_char_limit <= 0:
        return messages.limit(0)
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    last = messages.withColumn("back", back).filter(F.col("back") <= (LECTURE_MESSAGES if lecture else CHAT_MESSAGES)).drop("back")
    if not lecture:
        return last
    share = F.greatest(F.lit(LEAST_MESSAGE), F.floor(F.lit(cfg.history_char_limit) / F.count("*").over(W.partitionBy("conv_id"))))
    return last.withColumn("text", truncate_to(F.col("text"), share.cast("int")))


def retrieval_query(questions: DataFrame, messages: DataFrame) -> DataFrame:
    """questions (conv_id, text, and where known file_name, title, path, section) to conv_id, query: the user's last two messages, the question, and what is known of source and section."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    last = messages.filter("role = 'user'").withColumn("back", back).filter("back <= 2").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    known = F.col("path").isNotNull()
    line = lambda label, c: F.concat(F.lit(f"Requested {label}: "), c)
    parts = F.array(F.col("text"), F.when(known, line("file", F.col("file_name"))), F.when(known, line("title", F.col("title"))), F.when(known, line("path", F.col("path"))), line("section", F.col("section")))
    earlier = F.coalesce(F.transform("m", lambda x: x["text"]), F.array().cast("array<string>"))
    return questions.join(last, "conv_id", "left").select("conv_id", F.array_join(F.array_compact(F.concat(earlier, parts)), "\n").alias("query"))


def retrieval_trace(routed: DataFrame, contexts: DataFrame, suggestions: DataFrame) -> DataFrame:
    """A row for each question of what was looked up: routed (q_id, mode, path, confidence, section, blocked_reason), contexts (q_id, n_chunks, n_chars), suggestions (q_id, rank, path, confidence)."""
    named = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(" ("), F.col("confidence").cast("string"), F.lit("%)"))
    some = suggestions.select("q_id", "rank", named.alias("s")).groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]).alias("suggestions"))
    out = routed.select("q_id", "mode", "path", "confidence", "section", "blocked_reason").join(contexts.select("q_id", "n_chunks", "n_chars"), "q_id", "left").join(some, "q_id", "left")
    blocked = F.col("blocked_reason").isNotNull()
    none = F.array().cast("array<string>")
    counts = [F.when(blocked, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("n_chunks", "n_chars")]
    return out.select("q_id", "mode", "path", "confidence", "section", "blocked_reason", *counts, F.when(blocked & F.col("path").isNull(), F.coalesce("suggestions", none)).otherwise(none).alias("suggestions"))


class Generator(Protocol):
    """A model that answers prompts: rows (q_id, system, user) to rows (q_id, answer)."""

    def answer(self, prompts: DataFrame) -> DataFrame: ...


class PromptOnly:
    """Answers with the prompt itself, where there is no model."""

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("q_id", F.concat_ws("\n\n", "system", "user").alias("answer"))


def prompts(questions: DataFrame, contexts: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """questions (q_id, text, lecture, blocked_reason), contexts (q_id, context) to q_id, system, user of those that may be answered: not blocked, and with sources if nothing else may be used."""
    rows = questions.filter("blocked_reason is null").join(contexts.select("q_id", "context"), "q_id", "inner" if cfg.only_sources else "left")
    return rows.select("q_id", system_prompt(F.col("lecture"), cfg.only_sources).alias("system"), user_prompt(F.col("text"), F.col("context")).alias("user"))


def kept_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, question, answer, state: complete, stopped or error, failure) to the messages that are stored: conv_id, turn, role, text, request_state.

    A turn is stored whole, as a question and an answer with its state; of a failed one the answer holds the failure. ``context_messages`` leaves failed turns out.
    """
    answer = F.when(F.col("state") == "error", F.col("failure")).otherwise(F.coalesce("answer", F.lit("")))
    both = F.array(F.struct((F.col("turn") * 2).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((F.col("turn") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), answer.alias("text")))
    return turns.select("conv_id", F.explode(both).alias("m"), F.col("state").alias("request_state")).select("conv_id", "m.*", "request_state")


def context_messages(messages: DataFrame) -> DataFrame:
    return messages.filter("request_state <> 'error'")


def generation_profile(lecture: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """struct(mode, model): lectures go to the lecture model, if one is set."""
    model = F.when(lecture, cfg.lecture_model.strip() or cfg.chat_model).otherwise(cfg.chat_model)
    return F.struct(F.when(lecture, "lecture").otherwise("chat").alias("mode"), model.alias("model"))


Answer = Callable[[DataFrame], DataFrame]

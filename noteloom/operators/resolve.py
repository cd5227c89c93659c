"""Which indexed source a question means: scores of all sources, the one that wins clearly, suggestions, and what a conversation says before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import canonical_tokens, name_score, normalize_name
from ..functions.phrases import requested_source_phrase
from .search import question_blocks

#: The least score of a match and of a suggestion, and the least lead over the next match.
MATCH, SUGGESTION, LEAD = 68, 35, 5
#: How many earlier messages of a user, and cited answers, are looked at.
EARLIER_QUESTIONS, EARLIER_ANSWERS = 6, 4


def asked_names(questions: DataFrame) -> DataFrame:
    """questions (q_id, text) to (q_id, phrase, asked, stems); questions that name no source are left out."""
    # Exploded, so that the filter does not work the phrase out a second time.
    named = questions.select("q_id", F.explode_outer(F.array(requested_source_phrase(F.col("text")))).alias("phrase")).filter("phrase is not null")
    return named.withColumn("asked", normalize_name(F.col("phrase"))).withColumn("stems", canonical_tokens(F.col("asked")))


def source_names(sources: DataFrame) -> DataFrame:
    """sources (path, file_name, title) with their distinct normal names and these names' stems."""
    flat = sources.select("path", F.explode(F.array_distinct(F.array("title", "file_name", F.element_at(F.split("path", "/"), -1)))).alias("name"))
    normal = flat.filter("name is not null").withColumn("name", normalize_name(F.col("name")))
    return normal.filter("name <> ''").select("path", "name", canonical_tokens(F.col("name")).alias("stems")).distinct()


def name_scores(asked: DataFrame, sources: DataFrame, least: float = 0.0) -> DataFrame:
    """(q_id, path, score) of each distinct asked name, which is the q_id here, and each source; only scores of at least ``least``.

    Questions that ask by the same name are scored once. The names are sent to the sources in blocks; each source's name is scored where it lies, and
    only the best score of a source's names leaves its task's partial aggregation.
    """
    names, out = source_names(sources), None
    for block in question_blocks(asked.select(F.col("asked").alias("q_id"), F.col("stems").alias("asked_stems")).distinct()):
        hits = names.join(F.broadcast(block)).select("q_id", "path", name_score(F.col("q_id"), F.col("asked_stems"), F.col("name"), F.col("stems")).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out.filter(F.col("score") >= least).groupBy("q_id", "path").agg(F.max("score").alias("score"))


def to_questions(asked: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for asked names, for each question that asks by them."""
    return asked.select("q_id", "asked").join(found.withColumnRenamed("q_id", "asked"), "asked").drop("asked")


def scores(questions: DataFrame, sources: DataFrame, least: float = 0.0) -> DataFrame:
    """(q_id, path, score) of each question that names a source and each source; only scores of at least ``least``."""
    asked = asked_names(questions)
    return to_questions(asked, name_scores(asked, sources, least))


def ranked(scored: DataFrame, keep: int) -> DataFrame:
    order = W.partitionBy("q_id").orderBy(F.col("score").desc(), "path")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def resolve(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(q_id, path, confidence): the best match of each question, if no other match comes near it."""
    asked = asked_names(questions)
    two = ranked(name_scores(asked, sources, MATCH), 2)
    both = two.groupBy("q_id").agg(F.max_by("path", -F.col("rank")).alias("path"), F.max("score").alias("best"), F.min("score").alias("next"), F.count("*").alias("n"))
    clear = both.filter((F.col("n") == 1) | (F.col("best") - F.col("next") >= LEAD)).select("q_id", "path", F.floor(F.col("best") + 0.5).cast("int").alias("confidence"))
    return to_questions(asked, clear)


def suggest(questions: DataFrame, sources: DataFrame, keep: int = 3) -> DataFrame:
    """(q_id, rank, path, confidence): the best ``keep`` sources that may be meant."""
    asked = asked_names(questions)
    return to_questions(asked, ranked(name_scores(asked, sources, SUGGESTION), keep)).select("q_id", "rank", "path", F.floor(F.col("score") + 0.5).cast("int").alias("confidence"))


def single_cited(messages: DataFrame) -> DataFrame:
    """Answers that cite exactly one source: messages (conv_id, turn, role, cited: array of paths) to (conv_id, turn, path)."""
    paths = messages.filter("role = 'assistant'").select("conv_id", "turn", F.array_distinct(F.filter("cited", lambda x: x != "")).alias("p"))
    return paths.filter(F.size("p") == 1).select("conv_id", "turn", F.col("p")[0].alias("path"))


def resolve_with_history(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """The source of each conversation's last user message: conv_id, turn, path, confidence, origin.

    messages: conv_id, turn, role, text, cited. The message's own words come first; if they name a source that is not
    found, the search ends. Otherwise the user's earlier messages count, newest first, then earlier answers that cite
    one source alone.
    """
    users = messages.filter("role = 'user'").select("conv_id", "turn", "text")
    recent = users.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc())) - 1).filter(F.col("back") <= EARLIER_QUESTIONS)
    recent = recent.withColumn("q_id", F.struct("conv_id", "turn"))
    found = resolve(recent.select("q_id", "text"), sources).select("q_id.*", "path", "confidence")
    phrase = requested_source_phrase(F.col("text")).isNotNull()
    tried = recent.join(found, ["conv_id", "turn"], "left").groupBy("conv_id").agg(
        F.max("turn").alias("turn"),
        F.bool_or((F.col("back") == 0) & phrase).alias("named"),
        F.max(F.when(F.col("back") == 0, F.struct("path", "confidence"))).alias("own"),
        F.max_by(F.struct("path", "confidence"), F.when((F.col("back") > 0) & F.col("path").isNotNull(), F.col("turn"))).alias("earlier"),
    )
    cited = F.size(F.filter("cited", lambda x: x != "")) > 0
    answers = messages.filter("role = 'assistant'").filter(cited)
    late = answers.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter(F.col("back") <= EARLIER_ANSWERS)
    last = single_cited(late).groupBy("conv_id").agg(F.max_by("path", "turn").alias("answer_path"))
    origin = (
        F.when(F.col("own.path").isNotNull(), "question").when(F.col("named"), "unresolved").when(F.col("earlier.path").isNotNull(), "conversation").when(F.col("answer_path").isNotNull(), "answer").otherwise("unresolved")
    )
    pick = lambda own, earlier, answer: F.when(F.col("origin") == "question", own).when(F.col("origin") == "conversation", earlier).when(F.col("origin") == "answer", answer)
    both = tried.join(last, "conv_id", "left").withColumn("origin", origin)
    return both.select("conv_id", "turn", pick(F.col("own.path"), F.col("earlier.path"), F.col("answer_path")).alias("path"), pick(F.col("own.confidence"), F.col("earlier.confidence"), F.lit(100)).alias("confidence"), "origin")

"""What is done with a question: an exact section, one source or the whole collection; and when nothing may be answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.phrases import is_lecture_request, same_section, section_request
from .context import budget, even_sample

#: Fixed value: chunks of an exact section that are looked at.
SECTION_LIMIT = 12


def exact_section(asked: DataFrame, chunks: DataFrame, limit: int = SECTION_LIMIT) -> DataFrame:
    """asked (q_id, path, section), chunks (path, section_number, page_start, chunk_index, ...): the first ``limit`` chunks of exactly this section, in
    document order, with their rank."""
    keyed = chunks.withColumn("section", same_section(F.col("section_number"))).filter("section <> ''")
    hits = keyed.join(asked.select("q_id", "path", same_section(F.col("section")).alias("section")), ["path", "section"])
    order = W.partitionBy("q_id").orderBy("page_start", "chunk_index")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def section_integrity(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Whether all chunks of a question are of the asked source and section: q_id, n, n_bad, bad_paths, bad_sections, sound.
    A question without chunks is not sound."""
    own = asked.select("q_id", F.col("path").alias("want_path"), same_section(F.col("section")).alias("want"))
    rows = own.join(hits.select("q_id", "path", same_section(F.col("section_number")).alias("got")), "q_id", "left")
    bad = F.col("path").isNotNull() & ((F.col("path") != F.col("want_path")) | (F.col("got") != F.col("want")))
    out = rows.groupBy("q_id").agg(
        F.count("path").alias("n"), F.count_if(bad).alias("n_bad"), F.array_sort(F.collect_set(F.when(bad, F.col("path")))).alias("bad_paths"), F.array_sort(F.collect_set(F.when(bad, F.col("got")))).alias("bad_sections")
    )
    return out.withColumn("sound", (F.col("n") > 0) & (F.col("n_bad") == 0))


def mode(section: Column, path: Column) -> Column:
    return F.when(section.isNotNull(), "section").when(path.isNotNull(), "source").otherwise("hybrid")


def route(questions: DataFrame, resolved: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions (q_id, text), resolved (q_id, path, confidence) to q_id, lecture, section, path, confidence, mode, n_chunks, blocked_reason.

    A question for a section is answered from that section of its source or not at all: without a source it is blocked
    (source-unresolved), likewise without chunks (section-not-indexed) and if any chunk is of another source or section (section-integrity-failed).
    """
    q = questions.select("q_id", is_lecture_request(F.col("text")).alias("lecture"), section_request(F.col("text")).alias("section"))
    both = q.join(resolved.select("q_id", "path", "confidence"), "q_id", "left")
    asked = both.filter("section is not null and path is not null").select("q_id", "path", "section")
    sound = section_integrity(asked, exact_section(asked, chunks)).select("q_id", "n", "sound")
    out = both.withColumn("mode", mode(F.col("section"), F.col("path"))).join(sound, "q_id", "left")
    reason = F.when(F.col("mode") == "section", F.when(F.col("path").isNull(), "source-unresolved").when(F.col("n") == 0, "section-not-indexed").when(~F.col("sound"), "section-integrity-failed"))
    return out.select("q_id", "lecture", "section", "path", "confidence", "mode", F.coalesce("n", F.lit(0)).alias("n_chunks"), reason.alias("blocked_reason"))


def within_budget(ranked: DataFrame, lecture: bool, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """ranked (q_id, rank, content): the chunks that go into an answer; a lecture takes evenly spaced ones."""
    if lecture:
        return even_sample(ranked, cfg.lecture_chunks)
    return budget(ranked, cfg.context_chunks, cfg.context_chars)

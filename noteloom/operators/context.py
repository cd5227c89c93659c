"""Context budgets, even samples and the assembled context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def budget(ranked: DataFrame, max_chunks: int, max_chars: int) -> DataFrame:
    """ranked (q_id, rank, content, or chars, its length): taken in order up to the first that would overflow; the first is always kept. n is the place, used the characters up to it.

    Where texts are long, give chars instead of content and join the texts to what is kept."""
    w = W.partitionBy("q_id").orderBy("rank")
    first = ranked.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_chunks)
    chars = F.col("chars") if "chars" in ranked.columns else F.length("content")
    used = F.sum(chars).over(w.rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("used", used).filter((F.col("n") == 1) | (F.col("used") <= max_chars))


def even_sample(rows: DataFrame, keep: int) -> DataFrame:
    """rows (q_id, rank): ``keep`` of n rows, evenly spaced, first and last included."""
    w = W.partitionBy("q_id")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("rank")) - 1
    if keep <= 1:
        return rows.withColumn("i", i).filter("i = 0").drop("i")
    slot = F.floor(F.col("i") * (keep - 1) / (F.col("n") - 1) + 0.5)
    back = F.floor(slot * (F.col("n") - 1) / (keep - 1) + 0.5)
    near = [F.floor((slot + d) * (F.col("n") - 1) / (keep - 1) + 0.5) == F.col("i") for d in (-1, 1)]
    return rows.withColumn("n", n).withColumn("i", i).filter((F.col("n") <= keep) | (back == F.col("i")) | near[0] | near[1]).drop("n", "i")


def assemble(kept: DataFrame) -> DataFrame:
    """kept (q_id, n, path, heading, content) to one numbered context per question."""
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("path"), F.lit(" - "), F.col("heading"), F.lit("\n"), F.col("content"))
    blocks = F.array_sort(F.collect_list(F.struct("n", block.alias("b"))))
    return kept.groupBy("q_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"))

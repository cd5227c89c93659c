"""What an answer cites: the columns that are kept of a chunk, links to the cited place, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a cited source.
CITED = ("file_path", "heading", "score", "source_type", "page_start", "page_end", "section_number", "section_title")


def retrieved(hits: DataFrame) -> DataFrame:
    """Hits with every column of a result and no vector; missing texts become '', numbers 0, lists empty, and an unknown source type Markdown."""
    kinds = {"id": "string", "file_path": "string", "file_name": "string", "title": "string", "heading": "string", "section_number": "string", "section_title": "string", "content": "string", "tags": "array<string>", "links": "array<string>", "page_start": "int", "page_end": "int", "chunk_index": "int", "score": "double"}
    blank = {"string": F.lit(""), "int": F.lit(0), "double": F.lit(0.0), "array<string>": F.array().cast("array<string>")}
    columns = [F.coalesce(F.col(c).cast(k), blank[k]).alias(c) if c in hits.columns else blank[k].alias(c) for c, k in kinds.items()]
    kind = F.when(F.col("source_type") == "pdf", "pdf").otherwise("markdown") if "source_type" in hits.columns else F.lit("markdown")
    keys = [c for c in ("q_id", "rank") if c in hits.columns]
    return hits.select(*keys, *columns, kind.alias("source_type"))


def cited_sources(hits: DataFrame) -> DataFrame:
    """The columns of retrieved hits that a message keeps of each source."""
    return hits.select(*[c for c in ("q_id", "rank") if c in hits.columns], *CITED)


def _page(name: str) -> Column:
    page = F.floor(F.col(name))
    return F.when(page > 0, page)


def target(path: Column) -> Column:
    """The link of a row (path, heading, page_start): a paged source at its page, a note at its heading, else the file."""
    pdf = F.lower(path).endswith(".pdf")
    page = F.coalesce(F.concat(F.lit("#page="), _page("page_start").cast("string")), F.lit(""))
    heading = F.when(F.coalesce(F.col("heading"), F.lit("")) != "", F.concat(F.lit("#"), "heading")).otherwise("")
    return F.concat(path, F.when(pdf, page).when(F.lower(path).endswith(".md"), heading).otherwise(""))


def targets(cited: DataFrame, files: DataFrame) -> DataFrame:
    """cited with found, whether its file (path) is still there, and target, null if it is not."""
    there = files.select("path").distinct().withColumn("found", F.lit(True))
    both = cited.join(there, "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return both.withColumn("target", F.when(F.col("found"), target(F.col("path"))))


def label(number: Column) -> Column:
    """The label of a row (path, heading, page_start, page_end, section_number, section_title): number, path, pages, and section or heading."""
    first, last = _page("page_start"), _page("page_end")
    pages = F.when(last > first, F.concat(F.lit(" (PDF pp. "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))).when(first.isNotNull(), F.concat(F.lit(" (PDF p. "), first.cast("string"), F.lit(")"))).otherwise("")
    pages = F.when(F.lower("path").endswith(".pdf"), pages).otherwise("")
    section = F.concat(F.lit(" → §"), F.col("section_number"), F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" "), "section_title")).otherwise(""))
    where = F.when(F.coalesce("section_number", F.lit("")) != "", section).when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" → "), "heading")).otherwise("")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.col("path"), pages, where)

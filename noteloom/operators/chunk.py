"""Chunking of Markdown notes by headings, fences and size, as one fold in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.names import GAP, normalize_name, strip
from ..functions.sections import same_key
from ..functions.text import strip_frontmatter

#: Closing signs need no blank before them: the heading of "# C#" is C.
HEADING = rf"^(#{{1,6}}){GAP}+(.+?){GAP}*#*{GAP}*\z"
_STATE = "struct<stack:array<string>,buf:array<string>,size:bigint,fence:boolean,out:array<struct<heading:string,content:string>>>"


def _fold(cfg: EngineConfig):
    def flushed(s: Column) -> Column:
        body = strip(F.array_join(s["buf"], "\n"))
        path = F.array_join(F.filter(s["stack"], lambda x: x != ""), " > ")
        row = F.struct(F.when(path == "", "Document").otherwise(path).alias("heading"), body.alias("content"))
        return F.when(body == "", s["out"]).otherwise(F.concat(s["out"], F.array(row)))

    def state(stack: Column, buf: Column, size: Column, fence: Column, out: Column) -> Column:
        return F.struct(stack.alias("stack"), buf.alias("buf"), size.cast("long").alias("size"), fence.alias("fence"), out.alias("out"))

    def step(s: Column, line: Column) -> Column:
        empty = F.array().cast("array<string>")
        is_fence = line.rlike(rf"^{GAP}*(?:```|~~~)")
        level = F.length(F.regexp_extract(line, HEADING, 1))
        heading = strip(F.regexp_extract(line, HEADING, 2))
        stack = F.concat(F.slice(F.concat(s["stack"], F.array_repeat(F.lit(""), 6)), F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(heading))
        joined = s["size"] + F.length(line) + (F.size(s["buf"]) > 0).cast("int")
        over = (F.size(s["buf"]) > 0) & (s["size"] + F.length(line) + 1 > cfg.chunk_max)
        cut = state(s["stack"], F.array(line), F.length(line), s["fence"], flushed(s))
        kept = state(s["stack"], F.concat(s["buf"], F.array(line)), joined, s["fence"], s["out"])
        done = (strip(line) == "") & (F.when(over, F.length(line)).otherwise(joined) >= cfg.chunk_target)
        whole = F.when(over, state(s["stack"], F.array(line), F.length(line), s["fence"], flushed(s))).otherwise(kept)
        ended = state(s["stack"], empty, F.lit(0), s["fence"], F.when(over, flushed(cut)).otherwise(flushed(kept)))
        return (
            F.when(is_fence, state(s["stack"], F.concat(s["buf"], F.array(line)), joined, ~s["fence"], s["out"]))
            .when(~s["fence"] & (level > 0), state(stack, empty, F.lit(0), s["fence"], flushed(s)))
            .when(done, ended)
            .otherwise(whole)
        )

    return step, flushed


def chunk_markdown(sources: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, text) to (chunk_id, path, chunk_index, heading, content). No shuffle and no Python."""
    step, flushed = _fold(cfg)
    start = F.from_json(F.lit('{"stack":[],"buf":[],"size":0,"fence":false,"out":[]}'), _STATE)
    rows = F.aggregate(F.split(strip_frontmatter(F.col("text")), "\n"), start, step, flushed)
    got = sources.select("path", F.posexplode(rows).alias("chunk_index", "c"))
    return got.select(F.concat_ws("::", "path", "chunk_index").alias("chunk_id"), "path", "chunk_index", "c.heading", "c.content")


def chunk_rows(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows that are indexed. chunks: path, chunk_index, heading, content, and of paged sources section_number, section_title, page_start, page_end;
    sources: path, source_type, title (null: the file's name), mtime, tags, links, properties (arrays). Missing values become
    empty texts, empty arrays and page 0; a chunk of no numbered section has the key __none__, a source in no folder the folder ''."""
    file = F.element_at(F.split("path", "/"), -1)
    base = F.regexp_replace(file, r"\.[^.]*\z", "")
    title = F.coalesce(F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit("")), base)
    kind = F.when(F.lower(F.coalesce("source_type", F.lit(""))) == "pdf", "pdf").otherwise("markdown")
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("tags", "links", "properties")]
    own = sources.select("path", kind.alias("source_type"), title.alias("title"), F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"), *lists)
    own = own.withColumn("source_search_name", F.concat_ws(" ", normalize_name(base), normalize_name(F.col("title"))))
    for c, kind_ in (("section_number", "string"), ("section_title", "string"), ("page_start", "int"), ("page_end", "int")):
        blank = F.lit("" if kind_ == "string" else 0)
        chunks = chunks.withColumn(c, F.coalesce(F.col(c), blank) if c in chunks.columns else blank)
    rows = chunks.join(own, "path")
    return rows.select(
        F.concat_ws("::", "path", "chunk_index").alias("id"), F.col("path").alias("source_key"), "source_type", same_key(F.col("section_number")).alias("section_key"), "source_search_name", F.col("path").alias("file_path"), file.alias("file_name"),
        F.regexp_extract("path", "^(.*)/[^/]*\\z", 1).alias("folder"), "title", "heading", "section_number", "section_title", "content", "tags", "links", "properties", "page_start", "page_end", "chunk_index", "mtime",
    )


def embedding_text(rows: DataFrame) -> DataFrame:
    """``chunk_rows`` with embedding_text: labelled header lines, a blank line, the content."""
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    numbered, pages = F.col("section_number") != "", (F.col("source_type") == "pdf") & (F.col("page_start") > 0)
    first, last = F.col("page_start").cast("string"), F.col("page_end").cast("string")
    head = [
        line("Document", F.col("title")), line("File", F.col("file_name")), line("Path", F.col("file_path")), line("Source type", F.col("source_type")), line("Heading", F.col("heading")),
        F.when(numbered, line("Section number", F.col("section_number"))), F.when(numbered & (F.col("section_title") != ""), line("Section title", F.col("section_title"))),
        F.when(pages & (first == last), line("PDF page", first)), F.when(pages & (first != last), line("PDF pages", F.concat(first, F.lit("-"), last))),
        F.when(F.size("tags") > 0, line("Tags", F.array_join("tags", ", "))), F.when(F.size("properties") > 0, line("Properties", F.array_join("properties", ", "))),
    ]
    return rows.withColumn("embedding_text", F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), F.col("content")))

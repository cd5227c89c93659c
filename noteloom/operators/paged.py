"""Page texts: lines from positioned pieces, sections, and chunks of paged sources, one source a row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from ..config import EngineConfig
from ..functions import sections as X

#: Fixed value: pieces whose heights differ by more stand on different lines.
LINE_GAP = 2.5


def _joined(items: Iterator[tuple[str | None, float | None, bool | None]]) -> list[str]:
    """The lines of one page; texts hold no white space but single blanks."""
    lines: list[str] = []
    line: list[str] = []
    height = end = None
    shown = False  # whether the line is not blank

    def added() -> None:
        x = "".join(line)
        x = (_BLANKS.sub(" ", x) if "  " in x else x).strip(" ")
        if x:
            lines.append(x)

    for text, y, eol in items:
        if text is None:
            continue
        if y is not None:
            if height is not None and shown and not abs(y - height) <= LINE_GAP:
                added()
                line, end, shown = [], None, False
            height = y
        if text:
            if end is not None and end not in "-([{" and text[0] not in ",.;:!?%)]}":
                line.append(" ")
            line.append(text)
            end, shown = text[-1], shown or text != " "
        if eol:
            added()
            line, end, shown = [], None, False
    added()
    return lines


_BLANKS = re.compile(" +")


@F.arrow_udf(ArrayType(StringType()))
def _lines_of(items: pa.Array) -> pa.Array:
    flat = items.flatten()
    text = pc.replace_substring_regex(flat.field("str"), r"[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")
    columns = text, flat.field("y").cast(pa.float64()), flat.field("eol")
    sizes, at, out = pc.list_value_length(items).to_pylist(), 0, []
    for n in sizes:
        if n is None:
            out.append(None)
            continue
        out.append(_joined(zip(*(c.slice(at, n).to_pylist() for c in columns), strict=True)))
        at += n
    return pa.array(out, pa.list_(pa.string()))


def reconstruct_lines(items: Column) -> Column:
    """items (array of struct(str, y, eol), in reading order) to the lines of a page.

    A line ends before a piece at another height if it is not blank, and after a piece that says so. White space
    collapses, blank lines go. Pieces without text (null str) count for nothing, not even their height. One Arrow function over whole pages, as a
    fold of built-in ones copies the lines so far with each piece.
    """
    return _lines_of(items)


_SECTION = StructType().add("number", StringType()).add("title", StringType()).add("consumed", IntegerType())
_LINE = StructType().add("page", IntegerType()).add("line", StringType()).add("section", _SECTION).add("chapter", StringType()).add("heading", BooleanType())
_ODD = f"[{X.ODD_GAPS}]|^ |  | $"


def _numbered(pages: Column) -> Column:
    return F.transform(pages, lambda p: F.struct(p["page_number"].cast("int").alias("page"), p["lines"].alias("lines")))


def _read_pages(pages: pa.Array) -> Iterator[list[tuple[int | None, list[str]]] | None]:
    """For each source its pages (number, non-blank lines with single blanks); None if a page or its lines are null. Only lines that need it are rewritten."""
    page = pages.flatten()
    number, lines = page.flatten()
    flat = lines.flatten()
    text = flat.to_pylist()
    for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(flat, _ODD), False).to_numpy(zero_copy_only=False)):
        text[i] = X.single_gaps(text[i])
    numbers, sizes = number.to_pylist(), pc.list_value_length(lines).to_pylist()
    p = at = 0
    for n in pc.list_value_length(pages).to_pylist():
        if n is None:
            yield None
            continue
        out = []
        for k in range(p, p + n):
            size = sizes[k] or 0
            out.append((numbers[k], [x for x in text[at : at + size] if x]))
            at += size
        yield None if None in sizes[p : p + n] else out
        p += n


def _marked(lines: list[str]) -> Iterator[tuple[str, tuple[str, str, int] | None, str | None, bool]]:
    """The lines of one page with the section and chapter that begin there and whether they are headings."""
    for line, second, third in zip(lines, [*lines[1:], ""], [*lines[2:], "", ""], strict=False):
        yield line, X.detect_section(line, second, third), X.chapter_heading(line), X.is_generic_heading(line)


@F.arrow_udf(ArrayType(_LINE))
def _lines_of_pages(pages: pa.Array) -> pa.Array:
    ends, nulls, rows = [0], [], []
    for source in _read_pages(pages):
        nulls.append(source is None)
        for page, lines in source or ():
            rows += [(page, *x) for x in _marked(lines)]
        ends.append(len(rows))
    page, line, found, chapter, heading = zip(*rows, strict=True) if rows else ((),) * 5
    number, title, consumed = ([x and x[i] for x in found] for i in range(3))
    section = pa.StructArray.from_arrays([pa.array(number, pa.string()), pa.array(title, pa.string()), pa.array(consumed, pa.int32())], ["number", "title", "consumed"], mask=pa.array([x is None for x in found], pa.bool_()))
    values = pa.StructArray.from_arrays([pa.array(page, pa.int32()), pa.array(line, pa.string()), section, pa.array(chapter, pa.string()), pa.array(heading, pa.bool_())], ["page", "line", "section", "chapter", "heading"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(nulls, pa.bool_()))


def page_lines(pages: Column) -> Column:
    """pages (array of struct(page_number, lines)) to their non-blank lines in order: array of struct(page, line, section, chapter, heading).
    A section looks ahead within its page only. One Arrow function over whole sources, as built-in ones are interpreted within lambdas, line by line."""
    return _lines_of_pages(_numbered(pages))


class _Chunks:
    """Chunks of one source, line by line."""

    def __init__(self, cfg: EngineConfig):
        self.target, self.most = cfg.chunk_target, cfg.chunk_max
        self.heading, self.number, self.title = "Document", "", ""
        self.buf: list[str] = []
        self.chars = self.skip = 0
        self.first: int | None = 0
        self.last: int | None = 0
        self.out: list[tuple] = []

    def flush(self) -> None:
        if self.buf:
            self.out.append((self.heading, self.number, self.title, "\n".join(self.buf), self.first, self.last))

    def begin(self, page: int | None, heading: str, number: str, title: str) -> None:
        """A new chunk that starts with its heading."""
        self.flush()
        self.heading, self.number, self.title = heading, number, title
        self.buf, self.chars, self.first, self.last = [heading], len(heading) + 1, page, page

    def body(self, page: int | None, line: str) -> None:
        size = len(line) + 1
        over = self.chars > 0 and self.chars + size > self.most
        if over:
            self.flush()
        if over or self.chars == 0:
            self.buf, self.chars, self.first = [], 0, page
        self.buf.append(line)
        self.chars, self.last = self.chars + size, page
        if self.chars >= self.target:
            self.flush()
            self.buf, self.chars, self.first, self.last = [], 0, 0, 0

    def add(self, page: int | None, line: str, section: tuple[str, str, int] | None, chapter: str | None, heading: bool) -> None:
        if self.skip > 0:
            self.skip -= 1
        elif section:
            number, title, consumed = section
            if number != self.number:
                self.begin(page, X.section_heading(number, title), number, title)
            elif self.title == "":
                self.title, self.heading = title, X.section_heading(number, title)
            self.skip = consumed - 1
        elif chapter is not None:
            self.begin(page, chapter, "", "")
        elif heading:
            self.begin(page, line, self.number, self.title)
        else:
            self.body(page, line)


_CHUNK = "heading string, section_number string, section_title string, content string, page_start int, page_end int"


def chunk_pages(sources: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """sources (path, pages: array of struct(page_number, lines)) to chunks: chunk_id, path, chunk_index, heading, section_number, section_title, content, page_start, page_end.

    A section, a chapter or a heading in capitals begins a chunk; a chapter clears the section, a heading keeps it. A section's number again,
    as in running headers, begins nothing and at most gives the title that was missing. Chunks end before 4200 characters
    and after 2800; they may cross pages. No shuffle; lines are marked and dealt to chunks by one Arrow function over whole sources.
    """
    kinds = [pa.int32(), *[pa.string()] * 4, pa.int32(), pa.int32()]
    names = ["chunk_index", *[x.split()[0] for x in _CHUNK.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            size = 0

            def made() -> pa.RecordBatch:
                columns = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["path", *names])  # noqa: B023

            for i, source in enumerate(_read_pages(batch.column(1))):
                chunks = _Chunks(cfg)
                for page, lines in source or ():
                    for x in _marked(lines):
                        chunks.add(page, *x)
                chunks.flush()
                rows += [(k, *c) for k, c in enumerate(chunks.out)]
                at += [i] * len(chunks.out)
                size += sum(len(c[3]) for c in chunks.out)
                if size > 1 << 24:
                    yield made()
                    rows, at, size = [], [], 0
            if rows:
                yield made()

    kind = sources.schema["path"].dataType.simpleString()
    got = sources.select("path", _numbered(F.col("pages")).alias("pages")).mapInArrow(run, f"path {kind}, chunk_index int, {_CHUNK}")
    return got.select(F.concat_ws("::", "path", "chunk_index").alias("chunk_id"), "*")


def _first_sections(pages: list[tuple[int | None, list[str]]]) -> dict[str, str]:
    """The title with which each section number of a source first begins, in this order."""
    out: dict[str, str] = {}
    for _, lines in pages:
        ahead, i = [*lines, "", ""], 0
        while i < len(lines):
            found = X.detect_section(ahead[i], ahead[i + 1], ahead[i + 2])
            if found:
                out.setdefault(found[0], found[1])
            i += found[2] if found else 1
    return out


def page_sections(sources: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """sources (path, pages: array of struct(page_number, lines)) to what ``sections_of`` needs of their chunks: path, chunk_index, section_number, section_title, one row
    for each number of a source, where it first begins. As each section that begins is a chunk, and chapters, headings and long texts only make more chunks of it,
    no chunk is made, and places of sections stand for indexes of chunks. Sources without a path (null) are one to ``sections_of``, so there the indexes count."""
    names, kinds = ["chunk_index", "section_number", "section_title"], [pa.int32(), pa.string(), pa.string()]

    def of_chunks(pages: list[tuple[int | None, list[str]]]) -> Iterator[tuple[int, str, str]]:
        chunks, seen = _Chunks(cfg), set()
        for page, lines in pages:
            for x in _marked(lines):
                chunks.add(page, *x)
        chunks.flush()
        for k, (_, number, title, *_) in enumerate(chunks.out):
            if number and number not in seen:
                seen.add(number)
                yield k, number, title

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            at: list[int] = []

            def made() -> pa.RecordBatch:
                columns = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["path", *names])  # noqa: B023

            for i, (source, unnamed) in enumerate(zip(_read_pages(batch.column(1)), batch.column(0).is_null().to_pylist(), strict=True)):
                rows += of_chunks(source or []) if unnamed else [(k, *x) for k, x in enumerate(_first_sections(source or []).items())]
                at += [i] * (len(rows) - len(at))
                if len(rows) > 1 << 16:
                    yield made()
                    rows, at = [], []
            if rows:
                yield made()

    kind = sources.schema["path"].dataType.simpleString()
    return sources.select("path", _numbered(F.col("pages")).alias("pages")).mapInArrow(run, f"path {kind}, chunk_index int, section_number string, section_title string")


def sections_of(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` sections of each source in the order of their numbers, part by part as integers (a missing part is 0), then as text:
    path, number, title (of the first chunk), place. The source's sections are gathered, never its chunks."""
    each = chunks.filter("section_number <> ''").groupBy("path", F.col("section_number").alias("number")).agg(F.min_by("section_title", "chunk_index").alias("title"))
    parts = F.transform(F.split("number", r"\."), lambda x: x.cast("bigint"))
    # Without final zeros, arrays compare as if padded with zeros to one length.
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    order = F.row_number().over(W.partitionBy("path").orderBy(F.slice(parts, F.lit(1), last), "number"))
    return each.withColumn("place", order).filter(F.col("place") <= limit)

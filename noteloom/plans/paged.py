"""Queries of chunking, sections, lines, chunk rows and citations, over notes and pages made from whole ``documents``, each with SQL.

The notes and pages hold every line of the texts; headings, fences and section lines are put between them. The SQL of both
chunkers walks the lines by a recursive query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sections as X
from ..functions.text import strip_frontmatter
from ..operators import chunk, citations, paged
from ..sources.files import spread, table
from .registry import query

# ---------------------------------------------------------------- inputs

#: Lines put before a text's lines: of notes by (doc_id + place) % 9, of pages by (doc_id + place) % 8; {d} is doc_id % 5 + 1, {i} the place.
_NOTE_LINES = (("# Part {i} #",), ("## C#", ""), ("```", "# no heading", "```"), ("\t",), ("### Deep {i}##  ",), ("####### seven",), ("   ~~~", "#### none", "~~~"), (), ("# ", "#x"))
_PAGE_LINES = (("{d}.{i} Heading of part {i}",), ("{d} . {i}. AGAIN",), ("Section {d}.{i}.2", "A  Plain Title"), ("Chapter iv of {i}",), ("ALL IN CAPITALS {i}A",), ("{d}.", "{i}", "Third Title"), ("1.2 Entry ..... 12", "3.4 volts are applied."), ("{d}.", "7 With Title", " "))
LINES_A_PAGE = 12


def _filled(pattern: str, d: Column, i: Column) -> Column:
    return F.replace(F.replace(F.lit(pattern), F.lit("{d}"), d), F.lit("{i}"), i)


def _between(kinds: tuple[tuple[str, ...], ...], text: Column) -> Column:
    """The lines of a text with those of ``kinds`` before them."""

    def of(line: Column, at: Column) -> Column:
        which, d, i = (F.col("doc_id") + at) % len(kinds), (F.col("doc_id") % 5 + 1).cast("string"), at.cast("string")
        out = F.array(line)
        for k, lines in enumerate(kinds):
            if lines:
                out = F.when(which == k, F.array(*[_filled(x, d, i) for x in lines], line)).otherwise(out)
        return out

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), of))


def _between_sql(kinds: tuple[tuple[str, ...], ...]) -> str:
    quoted = lambda x: "'" + x.replace("{d}", "' || (doc_id % 5 + 1) || '").replace("{i}", "' || (i - 1) || '") + "'"
    each = " ".join(f"when {k} then [{', '.join(map(quoted, lines))}, x]" for k, lines in enumerate(kinds) if lines)
    return f"flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: case (doc_id + i - 1) % {len(kinds)} {each} else [x] end))"


def notes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\n---\n"), F.array_join(_between(_NOTE_LINES, F.col("text")), "\n")).alias("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), _between(_PAGE_LINES, F.col("text")).alias("all"))
    last = F.floor((F.size("all") - 1) / LINES_A_PAGE).cast("int")
    page = F.transform(F.sequence(F.lit(0), last), lambda p: F.struct((p + 1).alias("page_number"), F.slice(F.col("all"), p * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)).alias("lines")))
    return docs.select("doc_id", "path", page.alias("pages"))


# ---------------------------------------------------------------- SQL

_S = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_NOTES_SQL = f"""
md as (select doc_id, source || '/' || doc_id || '.md' as path, unnest(ls) as line, generate_subscripts(ls, 1) as k from (select doc_id, source, {_between_sql(_NOTE_LINES)} as ls from documents) z),
m1 as (select *, regexp_matches(line, '^{_S}*(```|~~~)') as fence, regexp_extract(line, '^(#{{1,6}}){_S}+(.+?){_S}*#*{_S}*$', 1) as marks, {_strip_sql(f"regexp_extract(line, '^(#{{1,6}}){_S}+(.+?){_S}*#*{_S}*$', 2)")} as head, {_strip_sql('line')} = '' as blank from md),
walk as (
  select doc_id, path, 0 as k, ['', '', '', '', '', ''] as st, '' as buf, false as any_, false as open, '' as h1, '' as c1, '' as h2, '' as c2 from m1 where k = 1
  union all
  select doc_id, path, k, st2, case when closed then '' when isfence or not cutting then longer when heading then '' else line end as buf, not closed and not heading as any_, case when isfence then not open else open end as open, h as h1, case when heading or over then buf else '' end as c1, h as h2, case when closed then case when over then line else longer end else '' end as c2
  from (select *, not heading and not isfence and blank and length(case when over then line else longer end) >= 2800 as closed, heading or over as cutting, case when heading then list_transform(st, lambda x, i: case when i < length(marks) then x when i = length(marks) then head else '' end) else st end as st2
    from (select *, case when any_ then buf || chr(10) || line else line end as longer, not isfence and not heading and any_ and length(buf) + length(line) + 1 > 4200 as over, coalesce(nullif(array_to_string(list_filter(st, lambda x: x <> ''), ' > '), ''), 'Document') as h
      from (select w.doc_id, w.path, m.k, w.st, w.buf, w.any_, w.open, m.line, m.fence as isfence, m.marks, m.head, m.blank, not m.fence and not w.open and m.marks <> '' as heading from walk w join m1 m on m.doc_id = w.doc_id and m.k = w.k + 1) a) b) c),
ends as (select doc_id, path, arg_max(st, k) as st, arg_max(buf, k) as buf, max(k) + 1 as k from walk group by doc_id, path),
found as (select doc_id, path, k, 1 as o, h1 as heading, {_strip_sql('c1')} as content from walk union all select doc_id, path, k, 2, h2, {_strip_sql('c2')} from walk
  union all select doc_id, path, k, 3, coalesce(nullif(array_to_string(list_filter(st, lambda x: x <> ''), ' > '), ''), 'Document'), {_strip_sql('buf')} from ends),
chunks as (select doc_id, path, heading, content, cast(row_number() over (partition by doc_id order by k, o) - 1 as int) as chunk_index from found where content <> '')
"""

_TOC = rf"(?:\.{{3,}}|…{{2,}}){_S}*\d{{1,4}}{_S}*$"


def _clean_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace(regexp_replace({x}, '{_S}+', ' ', 'g'), '^\\s*[-–—:]\\s*', '')")


def _title_sql(x: str) -> str:
    t = _clean_sql(x)
    return f"(length({t}) between 1 and 160 and len(string_split({t}, ' ')) <= 18 and not regexp_matches({t}, '{_TOC}') and not regexp_matches({t}, '\\s\\d{{1,4}}$') and not regexp_matches({t}, '^\\P{{L}}*\\p{{Ll}}') and (not regexp_matches({t}, '[.!?]$') or {t} = upper({t})))"


_NUM = rf"(\d+(?:{_S}*\.{_S}*\d+){{1,4}})\.?"
_ONE, _ONLY, _MORE = rf"(?i)^(?:section{_S}+)?{_NUM}{_S}+(.+)$", rf"(?i)^(?:section{_S}+)?{_NUM}{_S}*$", rf"^(\d+)\.?{_S}+(.+)$"
_key = lambda x: f"regexp_replace(regexp_replace({x}, '{_S}', '', 'g'), '\\.$', '')"
_PAGES_SQL = f"""
pd as (select doc_id, source || '/' || doc_id || '.pdf' as path, {_strip_sql(f"regexp_replace(raw, '{_S}+', ' ', 'g')")} as line, n, (n - 1) // {LINES_A_PAGE} + 1 as page from (select doc_id, source, unnest(ls) as raw, generate_subscripts(ls, 1) as n from (select doc_id, source, {_between_sql(_PAGE_LINES)} as ls from documents) z) y),
l1 as (select *, coalesce(lead(line) over w, '') as b, coalesce(lead(line, 2) over w, '') as c, row_number() over (partition by doc_id order by n) as k from pd where line <> '' window w as (partition by doc_id, page order by n)),
l2 as (select *, regexp_matches(line, '{_TOC}') as toc, regexp_extract(line, '{_ONE}', 1) as n1, regexp_extract(line, '{_ONE}', 2) as t1, regexp_extract(line, '{_ONLY}', 1) as n2, regexp_extract(line, '^(\\d+)\\.{_S}*$', 1) as major, regexp_extract(b, '^(\\d+)\\.?{_S}*$', 1) as minor, regexp_extract(b, '{_MORE}', 1) as mn, regexp_extract(b, '{_MORE}', 2) as mt from l1),
l3 as (select *, case when toc then 0 when t1 <> '' and {_title_sql('t1')} then 1 when n2 <> '' and {_title_sql('b')} then 2 when major <> '' and minor <> '' and {_title_sql('c')} then 3 when major <> '' and minor = '' and mt <> '' and {_title_sql('mt')} then 4 else 0 end as kind from l2),
lines as (select doc_id, path, k, page, line, kind, case kind when 1 then {_key('n1')} when 2 then {_key('n2')} when 3 then major || '.' || minor when 4 then major || '.' || mn else '' end as number, case kind when 1 then {_clean_sql('t1')} when 2 then {_clean_sql('b')} when 3 then {_clean_sql('c')} when 4 then {_clean_sql('mt')} else '' end as title,
  case kind when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 2 else 0 end as consumed, regexp_matches(line, '(?i)^chapter\\s+(\\d+|[ivxlcdm]+)\\b.{{0,160}}$') as chapter,
  length(line) between 4 and 100 and regexp_matches(line, '[A-Z]') and line = upper(line) and not regexp_matches(line, '[.!?]$') and not toc as caps from l3)
"""
_head = lambda n, t: f"case when {t} <> '' then {n} || ' ' || {t} else 'Section ' || {n} end"
_PAGED_SQL = f"""{_PAGES_SQL},
step as (
  select doc_id, path, 0::bigint as k, 'Document' as heading, '' as number, '' as title, '' as buf, 0::bigint as chars, 0::bigint as p0, 0::bigint as p1, 0 as skip, '' as e1, '' as e2, 'Document' as eh, '' as en, '' as et, 0::bigint as a0, 0::bigint as a1, 0::bigint as z0, 0::bigint as z1 from lines where k = 1
  union all
  select doc_id, path, k,
    case what when 'again' then case when fill then {_head('snumber', 'stitle')} else heading end when 'section' then {_head('snumber', 'stitle')} when 'chapter' then line when 'caps' then line else heading end,
    case what when 'section' then snumber when 'chapter' then '' else number end,
    case what when 'again' then case when fill then stitle else title end when 'section' then stitle when 'chapter' then '' else title end,
    case when what in ('skip', 'again') then buf when what in ('section', 'chapter', 'caps') then nh when full_ then '' else nb end,
    case when what in ('skip', 'again') then chars when what in ('section', 'chapter', 'caps') then length(nh) + 1 when full_ then 0 else nc end,
    case when what in ('skip', 'again') then p0 when what in ('section', 'chapter', 'caps') then page when full_ then 0 else n0 end,
    case when what in ('skip', 'again') then p1 when what in ('section', 'chapter', 'caps') then page when full_ then 0 else page end,
    case when what = 'skip' then skip - 1 when what in ('again', 'section') then consumed - 1 else skip end,
    case when what in ('section', 'chapter', 'caps') or what = 'body' and over then buf else '' end, case when full_ then nb else '' end, heading, number, title, p0, p1, n0, page
  from (select *, what = 'body' and nc >= 2800 as full_, case what when 'section' then {_head('snumber', 'stitle')} else line end as nh from
    (select *, case when over or buf = '' then line else buf || chr(10) || line end as nb, case when over then length(line) + 1 else chars + length(line) + 1 end as nc, case when over or chars = 0 then page else p0 end as n0 from
      (select s.*  exclude (k, e1, e2, eh, en, et, a0, a1, z0, z1), l.k, l.page, l.line, l.number as snumber, l.title as stitle, l.consumed, s.chars > 0 and s.chars + length(l.line) + 1 > 4200 as over, l.kind > 0 and l.number = s.number and s.title = '' and l.title <> '' as fill,
        case when s.skip > 0 then 'skip' when l.kind > 0 and l.number = s.number then 'again' when l.kind > 0 then 'section' when l.chapter then 'chapter' when l.caps then 'caps' else 'body' end as what
        from step s join lines l on l.doc_id = s.doc_id and l.k = s.k + 1) a) b) c),
ends as (select doc_id, path, max(k) + 1 as k, arg_max((heading, number, title, buf, p0, p1), k) as r from step group by doc_id, path),
found as (select doc_id, path, k, 1 as o, eh as heading, en as section_number, et as section_title, {_strip_sql('e1')} as content, a0 as page_start, a1 as page_end from step
  union all select doc_id, path, k, 2, eh, en, et, {_strip_sql('e2')}, z0, z1 from step union all select doc_id, path, k, 3, r[1], r[2], r[3], {_strip_sql('r[4]')}, r[5], r[6] from ends),
chunks as (select doc_id, path, heading, section_number, section_title, content, cast(page_start as int) as page_start, cast(page_end as int) as page_end, cast(row_number() over (partition by doc_id order by k, o) - 1 as int) as chunk_index from found where content <> '')
"""

# ---------------------------------------------------------------- chunks


@query(f"with recursive {_NOTES_SQL} select path || '::' || chunk_index as chunk_id, heading, sha256(content) as content_sha256 from chunks")
def chunk_markdown(spark, d):
    return chunk.chunk_markdown(notes(spark, d)).select("chunk_id", "heading", F.sha2("content", 256).alias("content_sha256"))


@query(f"with recursive {_NOTES_SQL} select path, list(distinct heading order by heading) as headings from chunks group by path")
def chunk_heading_path(spark, d):
    return chunk.chunk_markdown(notes(spark, d)).groupBy("path").agg(F.array_sort(F.collect_set("heading")).alias("headings"))


@query(f"with {_PAGES_SQL} select path, cast(page as int) as page, line, number, title, consumed from lines where kind > 0")
def detect_sections(spark, d):
    lines = pages(spark, d).select("path", F.explode(paged.page_lines(F.col("pages"))).alias("x")).filter("x.section is not null")
    return lines.select("path", "x.page", "x.line", "x.section.number", "x.section.title", "x.section.consumed")


@query(f"with recursive {_PAGED_SQL} select path || '::' || chunk_index as chunk_id, heading, section_number, section_title, sha256(content) as content_sha256, page_start, page_end from chunks")
def chunk_paged(spark, d):
    return paged.chunk_pages(pages(spark, d)).select("chunk_id", "heading", "section_number", "section_title", F.sha2("content", 256).alias("content_sha256"), "page_start", "page_end")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("t1"), F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string"))))
    return docs.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.when(F.col("doc_id") % 4 > 0, "pdf").alias("source_type"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" Volume "), F.col("doc_id").cast("string"), F.lit(" "))).alias("title"),
        (F.col("doc_id") * 1000).alias("mtime"), tags.alias("tags"), F.array().cast("array<string>").alias("links"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("k=v"))).alias("properties"),
    )


_OWN = "own as (select doc_id, source, doc_id || '.pdf' as file_name, case when doc_id % 4 > 0 then 'pdf' else 'markdown' end as source_type, case when doc_id % 3 > 0 then 'Volume ' || doc_id else cast(doc_id as varchar) end as title, case when doc_id % 2 = 0 then ['t1', 'x' || (doc_id % 3)] else []::varchar[] end as tags, case when doc_id % 5 = 0 then ['k=v'] else []::varchar[] end as properties from documents)"


@query(
    f"with recursive {_PAGED_SQL}, {_OWN} select path || '::' || chunk_index as id, source_type, case when section_number = '' then '__none__' else section_number end as section_key, doc_id || ' ' || lower(title) as source_search_name, file_name, source as folder, title, tags, properties, page_start, page_end, chunk_index, doc_id * 1000 as mtime from chunks join own using (doc_id)"
)
def chunk_rows(spark, d):
    rows = chunk.chunk_rows(paged.chunk_pages(pages(spark, d)), _sources(spark, d))
    return rows.select("id", "source_type", "section_key", "source_search_name", "file_name", "folder", "title", "tags", "properties", "page_start", "page_end", "chunk_index", "mtime")


@query(
    f"with recursive {_PAGED_SQL}, {_OWN} select path || '::' || chunk_index as id, sha256(concat_ws(chr(10), 'Document: ' || title, 'File: ' || file_name, 'Path: ' || path, 'Source type: ' || source_type, 'Heading: ' || heading, case when section_number <> '' then 'Section number: ' || section_number end, case when section_number <> '' and section_title <> '' then 'Section title: ' || section_title end, "
    "case when source_type = 'pdf' and page_start > 0 then case when page_start = page_end then 'PDF page: ' || page_start else 'PDF pages: ' || page_start || '-' || page_end end end, case when len(tags) > 0 then 'Tags: ' || array_to_string(tags, ', ') end, case when len(properties) > 0 then 'Properties: ' || array_to_string(properties, ', ') end, '', content)) as text_sha256 from chunks join own using (doc_id)"
)
def embedding_text(spark, d):
    rows = chunk.embedding_text(chunk.chunk_rows(paged.chunk_pages(pages(spark, d)), _sources(spark, d)))
    return rows.select("id", F.sha2("embedding_text", 256).alias("text_sha256"))


# ---------------------------------------------------------------- lines


@query(f"with {_PAGES_SQL} select doc_id, count(*) as n_headings from lines where caps group by doc_id")
def generic_headings(spark, d):
    lines = pages(spark, d).select("doc_id", F.explode(paged.page_lines(F.col("pages"))).alias("x"))
    return lines.filter("x.heading").groupBy("doc_id").agg(F.count("*").alias("n_headings"))


@query(f"with {_PAGES_SQL} select path, cast(page as int) as page, line from lines where regexp_matches(line, '{_TOC}')")
def toc_filter(spark, d):
    lines = pages(spark, d).select("path", F.explode(paged.page_lines(F.col("pages"))).alias("x"))
    return lines.filter(X.is_toc_entry(F.col("x.line"))).select("path", "x.page", "x.line")


@query(f"with {_PAGES_SQL} select line, bool_and({_title_sql('line')}) as is_title from lines group by line")
def section_title_filter(spark, d):
    lines = pages(spark, d).select(F.explode(paged.page_lines(F.col("pages"))).alias("x")).select("x.line")
    return lines.groupBy("line").agg(F.bool_and(X.is_section_title(F.col("line"))).alias("is_title"))


@query("select doc_id, (doc_id % 7) || '.' || (doc_id % 11) || '.' || (n_chars % 4) as number from documents")
def section_normalize(spark, d):
    n = lambda c, k: (F.col(c) % k).cast("string")
    raw = F.concat(F.lit(" "), n("doc_id", 7), F.lit(" . "), n("doc_id", 11), F.lit("\t. "), n("n_chars", 4), F.lit(". "))
    return table(spark, d, "documents").select("doc_id", X.normalize_section(raw).alias("number"))


#: Words of a text as positioned pieces: a new height every seven words, every fifth word ends its line, every ninth holds a blank or nothing.
_PIECES_SQL = "w as (select doc_id, string_split(coalesce(text, ''), ' ') as ws from documents), i as (select doc_id, unnest(ws) as s, generate_subscripts(ws, 1) - 1 as seq from w), j as (select doc_id, seq, case when seq % 9 = 8 then '' when seq % 13 = 5 then '(' when seq % 13 = 6 then s || '-' else regexp_replace(s, '[\\s]+', ' ', 'g') end as s, 700 - 12.0 * (seq // 7) + (seq % 2) as y, seq % 5 = 4 and seq % 3 = 0 as eol from i)"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.coalesce("text", F.lit("")), " ")
    piece = lambda s, i: F.struct(F.when(i % 9 == 8, "").when(i % 13 == 5, "(").when(i % 13 == 6, F.concat(s, F.lit("-"))).otherwise(s).alias("str"), (700 - 12.0 * F.floor(i / 7) + i % 2).cast("double").alias("y"), ((i % 5 == 4) & (i % 3 == 0)).alias("eol"))
    return spread(table(spark, d, "documents")).select("doc_id", F.transform(words, piece).alias("items"))


_BREAKS = "[\\s\\x{a0}\\x{feff}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(
    f"with recursive {_PIECES_SQL}, p as (select doc_id, seq, regexp_replace(s, '{_BREAKS}+', ' ', 'g') as s, y, eol from j), "
    "walk as (select doc_id, -1::bigint as seq, '' as line, null::double as y, '' as e1, '' as e2 from p where seq = 0 union all "
    "select doc_id, seq, case when eol then '' else longer end, y, case when cut then line else '' end, case when eol then longer else '' end from (select *, case when s = '' then base when base <> '' and not (base like '%-' or regexp_matches(s, '^[,.;:!?%)\\]}]') or regexp_matches(base, '[(\\[{]$')) then base || ' ' || s else base || s end as longer from "
    "(select *, case when cut then '' else line end as base from (select w.doc_id, p.seq, w.line, p.s, p.y, p.eol, coalesce(abs(p.y - w.y) > 2.5, false) and trim(w.line) <> '' as cut from walk w join p on p.doc_id = w.doc_id and p.seq = w.seq + 1) a) b) c), "
    "r as (select doc_id, seq, 1 as o, e1 as line from walk union all select doc_id, seq, 2, e2 from walk union all select doc_id, max(seq) + 1, 3, arg_max(line, seq) from walk group by doc_id), "
    "t as (select doc_id, seq, o, trim(regexp_replace(line, ' +', ' ', 'g')) as line from r) select doc_id, count(*) as n_lines, sha256(string_agg(line, chr(10) order by seq, o)) as lines_sha256 from t where line <> '' group by doc_id"
)
def pdf_lines(spark, d):
    # Exploded, so that the filter does not build the lines a second time.
    lines = pieces(spark, d).select("doc_id", F.explode_outer(F.array(paged.reconstruct_lines(F.col("items")))).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.sha2(F.array_join("l", "\n"), 256).alias("lines_sha256")).filter("n_lines > 0")


# ---------------------------------------------------------------- sections of a source, citations


@query(
    f"with recursive {_PAGED_SQL}, g as (select path, section_number as number, arg_min(section_title, chunk_index) as title, list_transform(string_split(section_number, '.'), lambda x: cast(x as bigint)) as parts from chunks where section_number <> '' group by path, section_number), "
    "k as (select *, max(len(parts)) over () as most from g), s as (select path, number, title, row_number() over (partition by path order by list_transform(range(1, most + 1), lambda i: coalesce(parts[i], 0)), number) as place from k) select * from s where place <= 100"
)
def sections_sorted(spark, d):
    return paged.sections_of(paged.page_sections(pages(spark, d))).select("path", "number", "title", F.col("place").cast("long").alias("place"))


_CITED = "ci as (select doc_id, source || '/' || doc_id || case doc_id % 3 when 0 then '.md' when 1 then '.pdf' else '.PDF' end as path, case when doc_id % 4 = 0 then 'Document' else 'A > B ' || (doc_id % 5) end as heading, case when doc_id % 7 = 0 then null else cast(doc_id % 6 as double) + 0.5 * (doc_id % 2) end as page_start, cast(doc_id % 6 + doc_id % 2 as double) as page_end, case when doc_id % 5 = 0 then (doc_id % 9) || '.1' else '' end as number, case when doc_id % 10 = 0 then 'Sets' else '' end as title from documents)"


def cited(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.when(i % 3 == 0, ".md").when(i % 3 == 1, ".pdf").otherwise(".PDF")
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.col("source"), F.lit("/"), i.cast("string"), ext).alias("path"), F.when(i % 4 == 0, "Document").otherwise(F.concat(F.lit("A > B "), (i % 5).cast("string"))).alias("heading"), F.when(i % 7 != 0, (i % 6).cast("double") + 0.5 * (i % 2)).alias("page_start"),
        (i % 6 + i % 2).cast("double").alias("page_end"), F.when(i % 5 == 0, F.concat((i % 9).cast("string"), F.lit(".1"))).otherwise("").alias("section_number"), F.when(i % 10 == 0, "Sets").otherwise("").alias("section_title"),
    )


@query(
    f"with {_CITED} select ci.doc_id, ci.path, l.doc_id is not null as found, case when l.doc_id is null then null when lower(path) like '%.pdf' then path || case when floor(page_start) > 0 then '#page=' || cast(floor(page_start) as bigint) else '' end else path || case when heading <> '' then '#' || heading else '' end end as target from ci left join (select distinct doc_id from labels) l on l.doc_id = ci.doc_id"
)
def citation_targets(spark, d):
    rows = cited(spark, d)
    files = table(spark, d, "labels").select("doc_id").distinct().join(rows.select("doc_id", "path"), "doc_id").select("path")
    return citations.targets(rows, files).select("doc_id", "path", "found", "target")


@query(
    f"with {_CITED} select doc_id, '[' || (doc_id % 8 + 1) || '] ' || path || case when lower(path) like '%.pdf' and floor(page_start) > 0 then case when floor(page_end) > floor(page_start) then ' (PDF pp. ' || cast(floor(page_start) as bigint) || '-' || cast(floor(page_end) as bigint) || ')' else ' (PDF p. ' || cast(floor(page_start) as bigint) || ')' end else '' end || case when number <> '' then ' → §' || number || case when title <> '' then ' ' || title else '' end when heading <> '' then ' → ' || heading else '' end as label from ci"
)
def citation_labels(spark, d):
    return cited(spark, d).select("doc_id", citations.label(F.col("doc_id") % 8 + 1).alias("label"))

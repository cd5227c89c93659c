"""Queries of source names, questions and routes, over a library made from ``part`` and questions made from it, each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, phrases
from ..operators import resolve, route
from ..sources.files import spread, table
from .registry import query

# ---------------------------------------------------------------- inputs

#: A source for each name and type of a part.
_LIB = "lib as (select distinct p_name || ' ' || lower(p_type) as title, lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || lower(p_type) || '_v1.2.pdf' as path, replace(p_name, ' ', '_') || '_' || lower(p_type) || '_v1.2.pdf' as file_name from part)"
#: Wordings of questions; {t} is a title, {n} a section number.
_WORDINGS = (
    "What does {t} say for section {n}?", "section {n} of {t}", "Can you explain what section {n} talks about in my {t} book?", "In my {t} book, explain section {n}.", "{t} section {n}", "What about section {n} again?",
    "Can you create a lecture for section {n}?", "explain {t}s", "according to {t}, what is section {n}?", "Make slides for section {n}.", "please tell me about the {t} pdf", "What is said in sec. {n} from The_{t}_final.pdf?",
    "slide by slide on {t}", "build a presentation from {t}", "write a tutorial on {t}", "what is § {n} of {t}?",
)


def _wording_sql(at: str) -> str:
    each = " ".join(f"when {i} then '" + w.replace("{t}", "' || t || '").replace("{n}", "' || n || '") + "'" for i, w in enumerate(_WORDINGS))
    return f"case {at} {each} end"


_ALL_ASKS = f"asks as (select q_id, {_wording_sql('w')} as text from (select p_partkey as q_id, (p_partkey // 100 + p_partkey) % {len(_WORDINGS)} as w, p_name || ' ' || lower(p_type) as t, (p_size % 4 + 1) || '.' || (p_partkey % 3 + 1) as n from part) z)"
_ASKS = _ALL_ASKS.replace("from part)", "from part where p_partkey % 100 = 0)")


def _title() -> Column:
    return F.concat("p_name", F.lit(" "), F.lower("p_type"))


def _number() -> Column:
    return F.concat((F.col("p_size") % 4 + 1).cast("string"), F.lit("."), (F.col("p_partkey") % 3 + 1).cast("string"))


def library(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_type"), F.lit("_v1.2.pdf"))
    return table(spark, d, "part").select(_title().alias("title"), F.concat(F.lower("p_type"), F.lit("/"), file).alias("path"), file.alias("file_name")).distinct()


def worded(which: Column, title: Column, number: Column) -> Column:
    pattern = F.get(F.array(*[F.lit(w) for w in _WORDINGS]), which.cast("int"))
    return F.replace(F.replace(pattern, F.lit("{t}"), title), F.lit("{n}"), number)


def questions(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    which = (F.floor(F.col("p_partkey") / 100) + F.col("p_partkey")) % len(_WORDINGS)
    return spread(table(spark, d, "part")).filter(F.col("p_partkey") % every == 0).select(F.col("p_partkey").alias("q_id"), worded(which, _title(), _number()).alias("text"))


# ---------------------------------------------------------------- SQL of the functions

_STOPS = ", ".join(f"'{w}'" for w in names.STOP_WORDS)
_FILLERS = ", ".join(f"'{w}'" for w in phrases.FILLER)
_VERBS = ", ".join(f"'{w}'" for w in phrases.VERBS)


def sql_name(x: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\.(md|pdf)$', '', 'i'), '[_/\\\\-]+', ' ', 'g')"
    t = f"trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}. ]+', ' ', 'g'), ' +', ' ', 'g'))"
    return f"regexp_replace({t}, '( (v?[0-9]+([.][0-9]+)+|[0-9]+([.][0-9]+)?x[0-9]+([.][0-9]+)?|final|copy|scan))+$', '')"


def sql_tokens(normal: str) -> str:
    return f"list_filter(string_split({normal}, ' '), lambda w: length(w) >= 3 and w not in ({_STOPS}))"


def sql_stems(tokens: str) -> str:
    stem = "case when t like 'comput%' then 'comput' when length(t) > 5 and t like '%s' and t not like '%ss' then left(t, length(t) - 1) else t end"
    stem = stem.replace("(t", "(regexp_replace(w, '[^a-z0-9]', '', 'g')").replace(" t ", " regexp_replace(w, '[^a-z0-9]', '', 'g') ")
    return f"list_transform({tokens}, lambda w: {stem})"


def sql_framing(x: str) -> str:
    t = f"regexp_replace(trim({x}), '[,:;.!?]+$', '')"
    words = f"list_filter(string_split({sql_name(t)}, ' '), lambda w: w <> '')"
    return (
        f"({t} = '' or regexp_matches({t}, '(?i)^((can|could|would)\\s+you\\s+)?(please\\s+)?(create|make|write|build|generate|give|prepare|explain|summarize|teach|tell)\\b') "
        f"or regexp_matches({t}, '(?i)^(what|how)\\s+(about|does|do|is|are)\\b') or len(list_filter({words}, lambda w: length(w) >= 3 and w not in ({_STOPS}, {_FILLERS}))) = 0 or {words}[1] in ({_VERBS}))"
    )


_SQL_LEAD = (
    "(?i)^(\\s*((can|could|would)\\s+you\\s+(please\\s+)?|please\\s+|(create|make|write|build|generate|give|prepare)\\s+(me\\s+)?(a\\s+)?(lecture|lesson|presentation|slides?|slide\\s+deck)\\s+(about|on|for|from)?\\s*"
    "|(explain|summarize|teach|tell\\s+me\\s+about)\\s+|(what\\s+does|what\\s+do|what\\s+is\\s+in|according\\s+to|from|in)\\s+))+"
)


def sql_unframed(x: str) -> str:
    return f"trim(regexp_replace(trim({x}), '{_SQL_LEAD}', ''))"


def sql_clean(x: str) -> str:
    t = f"regexp_replace({x}, '^[\\s\"''`]+|[\\s\"''`,:;]+$', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '(?i)^(my|the)\\s+', ''), '(?i)\\s+(book|pdf|note|file|document)\\s*$', ''))"


_NOUN, _REF = "(?:book|pdf|note|document|file)", "\\b(?:section|sec\\.?)\\s*\\d+(?:\\.\\d+){1,4}"
_SQL_RULES = (
    f"(?i)\\b(?:my|the)\\s+(.{{4,180}}?)\\s+{_NOUN}\\b",
    f"(?i){_REF}\\b[^?.!]{{0,120}}?\\b(?:in|from|of)\\s+(?:(?:my|the)\\s+)?(.+?)(?:\\s+{_NOUN})?(?:[?.!]|$)",
    f"(?i){_REF}\\s+(?:of|from|in)\\s+(.+?)(?:[?.!]|$)",
    f"(?i)^\\s*(?:can\\s+you\\s+)?what\\s+does\\s+(?:(?:my|the)\\s+{_NOUN}\\s+)?(.+?)\\s+(?:says?|talks?|covers?|mentions?)\\b",
    "(?i)^\\s*(?:in|from|according\\s+to)\\s+(?:(?:my|the)\\s+)?(.+?)(?:,\\s*|\\s+)(?:what\\s+(?:does|is)|section|sec\\.?|§|explain|summarize|create|make|teach|tell)\\b",
)
_SQL_BEFORE = "(?i)^(.+?)\\s+(?:section|sec\\.?|§)\\s*\\d+(?:\\.\\d+){1,4}\\b"


def sql_phrases(asks: str = "asks") -> str:
    """CTEs to ``named`` (q_id, text, phrase)."""
    raw = ", ".join(f"regexp_extract(q, '{r}', 1)" for r in _SQL_RULES)
    return (
        f"p1 as (select q_id, text, trim(text) as q from {asks}), "
        f"p2 as (select *, regexp_extract(q, '{_SQL_BEFORE}', 1) as before, trim(regexp_replace(case when regexp_matches(q, '(?i)\\b(section|sec\\.?)\\s+\\d+(\\.\\d+){{1,4}}\\b') then regexp_replace(q, '(?is)\\b(section|sec\\.?)\\s+\\d+(\\.\\d+){{1,4}}\\b.*$', '') else regexp_replace(q, '(?is)§\\s*\\d+(\\.\\d+){{1,4}}\\b.*$', '') end, '[?!.]+$', '')) as rest from p1), "
        f"p3 as (select q_id, text, [{raw}, case when {sql_framing('before')} then '' else {sql_unframed('before')} end, case when {sql_framing('rest')} then '' else regexp_replace(regexp_replace({sql_unframed('rest')}, '(?i)^\\s*((my|the)\\s+)?{_NOUN}\\s+', ''), '(?i)\\s+(says?|talks?|covers?|mentions?)\\b.*$', '') end] as raws from p2), "
        f"p4 as (select q_id, text, unnest(list_transform(raws, lambda r: {sql_clean('r')})) as c, generate_subscripts(raws, 1) as i from p3), "
        f"named as (select p1.q_id, p1.text, x.phrase from p1 left join (select q_id, arg_min(c, i) as phrase from p4 where length(c) >= 4 and not {sql_framing('c')} group by q_id) x on x.q_id = p1.q_id)"
    )


def sql_scores() -> str:
    """CTEs from ``named`` and ``lib`` to ``scored`` (q_id, path, score)."""
    return (
        f"n1 as (select q_id, {sql_name('phrase')} as a from named where phrase is not null), n2 as (select q_id, a, {sql_stems(sql_tokens('a'))} as sa from n1), "
        f"l1 as (select distinct path, {sql_name('name')} as b from (select path, unnest([title, file_name]) as name from lib) z), l2 as (select path, b, {sql_stems(sql_tokens('b'))} as sb from l1 where length(b) >= 4), "
        "x1 as (select q_id, path, a, b, sa, sb, list_transform(sa, lambda w: left(w, 6)) as ka, list_transform(sb, lambda w: left(w, 6)) as kb, least(length(a), length(b)) as short, greatest(length(a), length(b)) as long from n2, l2), "
        "x2 as (select *, 1 - levenshtein(a, b) / long as edit, case when len(sa) = 0 or len(sb) = 0 then 0 else 2.0 * coalesce(list_sum(list_transform(list_distinct(ka), lambda k: least(len(list_filter(ka, lambda y: y = k)), len(list_filter(kb, lambda y: y = k))))), 0) / (len(sa) + len(sb)) end as dice, "
        "coalesce(list_min(list_filter(range(1, short + 1), lambda i: a[i] <> b[i])) - 1, short) / short as prefix from x1), "
        "x3 as (select q_id, path, case when a = b then 100 else least(100, greatest(case when len(sa) > 0 and array_to_string(sa, ' ') = array_to_string(sb, ' ') then 99 else 0 end, case when contains(a, b) or contains(b, a) then 90 + 10 * short / long else 0 end, edit * 100, dice * 96, (edit * 0.35::double + dice * 0.5::double + prefix * 0.15::double) * 100)) end as score from x2), "
        "scored as (select q_id, path, max(score) as score from x3 group by q_id, path)"
    )


_RESOLVED = "top as (select *, row_number() over (partition by q_id order by score desc, path) as rank, lead(score) over (partition by q_id order by score desc, path) as next from scored where score >= 68), resolved as (select q_id, path, cast(floor(score + 0.5) as int) as confidence from top where rank = 1 and (next is null or score - next >= 5))"

# ---------------------------------------------------------------- names


@query(f"with {_LIB} select path, {sql_name('file_name')} as name, {sql_tokens(sql_name('file_name'))} as tokens, {sql_stems(sql_tokens(sql_name('file_name')))} as stems from lib")
def canonical_tokens(spark, d):
    normal = names.normalize_name(F.col("file_name"))
    return library(spark, d).select("path", normal.alias("name")).select("path", "name", names.significant_tokens(F.col("name")).alias("tokens"), names.canonical_tokens(F.col("name")).alias("stems"))


_PAIRS = "w as (select p_partkey, lower(p_name) || ' ' || lower(p_type) as a, lower(p_type) || 's ' || left(lower(p_name), 6 + p_size % 4) as b from part)"


@query(
    f"with {_PAIRS}, s as (select *, {sql_stems(sql_tokens('a'))} as sa, {sql_stems(sql_tokens('b'))} as sb from w), k as (select *, list_transform(sa, lambda w: left(w, 6)) as ka, list_transform(sb, lambda w: left(w, 6)) as kb from s) "
    "select p_partkey, case when len(sa) = 0 or len(sb) = 0 then 0 else round(2.0 * coalesce(list_sum(list_transform(list_distinct(ka), lambda k: least(len(list_filter(ka, lambda y: y = k)), len(list_filter(kb, lambda y: y = k))))), 0) / (len(sa) + len(sb)), 6) end as dice, "
    "round(coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(length(a), length(b))) / least(length(a), length(b)), 6) as prefix from k"
)
def token_dice(spark, d):
    low = F.lower("p_name")
    a = F.concat(low, F.lit(" "), F.lower("p_type"))
    b = F.concat(F.lower("p_type"), F.lit("s "), F.substring(low, F.lit(1), 6 + F.col("p_size") % 4))
    pairs = table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    dice = names.token_dice(names.canonical_tokens(F.col("a")), names.canonical_tokens(F.col("b")))
    return pairs.select("p_partkey", F.round(dice, 6).alias("dice"), F.round(names.common_prefix(F.col("a"), F.col("b")), 6).alias("prefix"))


# ---------------------------------------------------------------- questions


@query(f"with {_ALL_ASKS}, {sql_phrases()} select q_id, phrase from named")
def requested_source_phrase(spark, d):
    return questions(spark, d, 1).select("q_id", phrases.requested_source_phrase(F.col("text")).alias("phrase"))


@query(
    f"with {_ALL_ASKS}, {sql_phrases()}, n as (select q_id, {sql_name('phrase')} as a from named where phrase is not null), t as (select q_id, a, {sql_tokens('a')} as w from n), s as (select *, list_filter({sql_stems('w')}, lambda x: length(x) >= 4) as st from t), "
    "e as (select q_id, unnest([a] || w || st || list_transform(list_filter(st, lambda x: length(x) >= 6), lambda x: left(x, 6))) as term, generate_subscripts([a] || w || st || list_transform(list_filter(st, lambda x: length(x) >= 6), lambda x: left(x, 6)), 1) as i from s), "
    "g as (select q_id, term, min(i) as i from e where term <> '' group by q_id, term) select q_id, cast(row_number() over (partition by q_id order by length(term) desc, i) as int) as place, term from g qualify place <= 12"
)
def source_terms(spark, d):
    asked = resolve.asked_names(questions(spark, d, 1))
    return asked.select("q_id", F.posexplode(names.search_terms(F.col("asked")))).select("q_id", (F.col("pos") + 1).alias("place"), F.col("col").alias("term"))


_SECTION_SQL = "coalesce(nullif(regexp_extract(text, '(?i)\\b(?:section|sec\\.?)\\s+(\\d+(?:\\.\\d+){1,4})\\b', 1), ''), nullif(regexp_extract(text, '§\\s*(\\d+(?:\\.\\d+){1,4})\\b', 1), ''))"
_SHOW = "\\b(lecture|lesson|presentation|slides?|slide deck)\\b"
_LECTURE_SQL = (
    f"regexp_matches(text, '(?i)slide[ -]*by[ -]*slide\\b') or regexp_matches(text, '(?i)\\b(create|make|build|generate|write|prepare|give|produce)\\b.{{0,80}}{_SHOW}') "
    f"or regexp_matches(text, '(?i){_SHOW}.{{0,50}}\\b(for|from|on|about|using)\\b') or regexp_matches(text, '(?i)\\b(lecture|class|teaching) slides?\\b')"
)


@query(f"with {_ALL_ASKS} select q_id, {_SECTION_SQL} as section from asks")
def section_request(spark, d):
    return questions(spark, d, 1).select("q_id", phrases.section_request(F.col("text")).alias("section"))


@query(f"with {_ALL_ASKS} select q_id, {_LECTURE_SQL} as lecture from asks")
def route_lecture(spark, d):
    return questions(spark, d, 1).select("q_id", phrases.is_lecture_request(F.col("text")).alias("lecture"))


# ---------------------------------------------------------------- sources


@query(f"with {_ASKS}, {_LIB}, {sql_phrases()}, {sql_scores()} select q_id, path, round(score, 6) as score from scored")
def source_score(spark, d):
    return resolve.scores(questions(spark, d), library(spark, d)).select("q_id", "path", F.round("score", 6).alias("score"))


@query(f"with {_ASKS}, {_LIB}, {sql_phrases()}, {sql_scores()}, {_RESOLVED} select * from resolved")
def source_resolve(spark, d):
    return resolve.resolve(questions(spark, d), library(spark, d))


@query(f"with {_ASKS}, {_LIB}, {sql_phrases()}, {sql_scores()} select q_id, cast(row_number() over (partition by q_id order by score desc, path) as int) as rank, path, cast(floor(score + 0.5) as int) as confidence from scored where score >= 35 qualify rank <= 3")
def source_suggest(spark, d):
    return resolve.suggest(questions(spark, d), library(spark, d))


# ---------------------------------------------------------------- conversations

#: Each turn's words, and what an answer cites, follow from its numbers; titles go round the library.
_LIST = "tl as (select list(title order by path) as titles, list(path order by path) as paths from lib)"
_MESSAGES = (
    f"msg as (select conv_id, turn, role, case when role = 'user' then {_wording_sql('(conv_id + turn) % ' + str(len(_WORDINGS)))} end as text, "
    "case when role = 'assistant' and (conv_id + turn) % 3 > 0 then list_distinct([paths[1 + (conv_id * 3) % len(paths)], paths[1 + (conv_id * 3 + (turn % 2) * 5) % len(paths)]]) else [] end as cited "
    "from (select *, titles[1 + (conv_id * 7 + turn) % len(titles)] as t, (conv_id % 4 + 1) || '.' || (turn % 3 + 1) as n from conversations, tl) z)"
)


def messages(spark: SparkSession, d: str) -> DataFrame:
    lists = library(spark, d).agg(F.array_sort(F.collect_list(F.struct("path", "title"))).alias("lib"))  # one row; the library is as small as its kinds of parts
    c = spread(table(spark, d, "conversations").select("conv_id", "turn", "role")).crossJoin(F.broadcast(lists))
    pick = lambda i: F.get("lib", (i % F.size("lib")).cast("int"))
    number = F.concat((F.col("conv_id") % 4 + 1).cast("string"), F.lit("."), (F.col("turn") % 3 + 1).cast("string"))
    text = worded((F.col("conv_id") + F.col("turn")) % len(_WORDINGS), pick(F.col("conv_id") * 7 + F.col("turn"))["title"], number)
    cited = F.array(pick(F.col("conv_id") * 3)["path"], pick(F.col("conv_id") * 3 + F.col("turn") % 2 * 5)["path"])
    cites = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 > 0)
    return c.select("conv_id", "turn", "role", F.when(F.col("role") == "user", text).alias("text"), F.when(cites, F.array_distinct(cited)).otherwise(F.array().cast("array<string>")).alias("cited"))


@query(f"with {_LIB}, {_LIST}, {_MESSAGES} select conv_id, turn, cited[1] as path from msg where role = 'assistant' and len(cited) = 1")
def conv_single_source(spark, d):
    return resolve.single_cited(messages(spark, d))


@query(
    f"with {_LIB}, {_LIST}, {_MESSAGES}, u as (select *, row_number() over (partition by conv_id order by turn desc) - 1 as back from msg where role = 'user' qualify back <= 6), "
    f"asks as (select conv_id * 1000 + turn as q_id, text from u), {sql_phrases()}, {sql_scores()}, {_RESOLVED}, "
    "f as (select u.conv_id, u.turn, back, r.path, r.confidence, n.phrase from u join named n on n.q_id = u.conv_id * 1000 + u.turn left join resolved r on r.q_id = n.q_id), "
    "t as (select conv_id, max(turn) as turn, bool_or(back = 0 and phrase is not null) as named, max(path) filter (where back = 0) as own, max(confidence) filter (where back = 0) as own_c, arg_max(path, turn) filter (where back > 0 and path is not null) as early, arg_max(confidence, turn) filter (where back > 0 and path is not null) as early_c from f group by conv_id), "
    "a as (select conv_id, arg_max(cited[1], turn) as path from (select * from msg where role = 'assistant' and len(cited) > 0 qualify row_number() over (partition by conv_id order by turn desc) <= 4) z where len(cited) = 1 group by conv_id), "
    "o as (select t.*, a.path as answer, case when own is not null then 'question' when named then 'unresolved' when early is not null then 'conversation' when a.path is not null then 'answer' else 'unresolved' end as origin from t left join a on a.conv_id = t.conv_id) "
    "select conv_id, turn, case origin when 'question' then own when 'conversation' then early when 'answer' then answer end as path, case origin when 'question' then own_c when 'conversation' then early_c when 'answer' then 100 end as confidence, origin from o"
)
def resolve_with_history(spark, d):
    return resolve.resolve_with_history(messages(spark, d), library(spark, d))


# ---------------------------------------------------------------- routes

#: A chunk for each part; a section's chunks are those of the parts of one source and number.
_CHUNKS = "ch as (select lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || lower(p_type) || '_v1.2.pdf' as path, (p_size % 4 + 1) || '.' || (p_partkey % 3 + 1) as section_number, p_size as page_start, p_partkey as chunk_index, 'Part ' || p_partkey as title from part where p_partkey % 5 > 0)"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_type"), F.lit("_v1.2.pdf"))
    return table(spark, d, "part").filter("p_partkey % 5 > 0").select(file.alias("path"), _number().alias("section_number"), F.col("p_size").alias("page_start"), F.col("p_partkey").alias("chunk_index"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("title"))


_ASKED = f"{_ASKS}, {_LIB}, {sql_phrases()}, {sql_scores()}, {_RESOLVED}, {_CHUNKS}, b as (select n.q_id, n.text, {_SECTION_SQL.replace('(text', '(n.text')} as section, {_LECTURE_SQL.replace('(text', '(n.text')} as lecture, r.path, r.confidence from named n left join resolved r on r.q_id = n.q_id), ex as (select b.q_id, ch.*, row_number() over (partition by b.q_id order by page_start, chunk_index) as rank from b join ch on ch.path = b.path and ch.section_number = b.section qualify rank <= 12)"


@query(f"with {_ASKED} select q_id, lecture, section, path, confidence, case when section is not null then 'section' when path is not null then 'source' else 'hybrid' end as mode, (select count(*) from ex where ex.q_id = b.q_id) as n_chunks from b")
def rag_route(spark, d):
    q = questions(spark, d)
    return route.route(q, resolve.resolve(q, library(spark, d)), chunks(spark, d)).drop("blocked_reason")


@query(f"with {_ASKED} select q_id, case when path is null then 'source-unresolved' else 'section-not-indexed' end as blocked_reason from b where section is not null and (path is null or not exists (select 1 from ex where ex.q_id = b.q_id))")
def rag_blocked(spark, d):
    q = questions(spark, d)
    return route.route(q, resolve.resolve(q, library(spark, d)), chunks(spark, d)).filter("blocked_reason is not null").select("q_id", "blocked_reason")


#: Every part asks for its own source and section.
_OWN = f"{_CHUNKS}, ask as (select p_partkey as q_id, lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || lower(p_type) || '_v1.2.pdf' as path, (p_size % 4 + 1) || '.' || (p_partkey % 3 + 1) as section from part where p_partkey % 100 = 0)"


def _own(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").filter("p_partkey % 100 = 0")
    file = F.concat(F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_type"), F.lit("_v1.2.pdf"))
    return own.select(F.col("p_partkey").alias("q_id"), file.alias("path"), F.concat(F.lit("§ "), F.replace(_number(), F.lit("."), F.lit(" . ")), F.lit(".")).alias("section"))


@query(f"with {_OWN} select q_id, ch.path, section_number, title, cast(row_number() over (partition by q_id order by page_start, chunk_index) as int) as rank from ask join ch on ch.path = ask.path and section_number = section qualify rank <= 12")
def section_exact(spark, d):
    return route.exact_section(_own(spark, d), chunks(spark, d)).select("q_id", "path", "section_number", "title", "rank")


@query(
    f"with {_OWN}, h as (select q_id, ask.path as want_path, section, ch.path, section_number from ask join ch on ch.path = ask.path and left(section_number, 1) = left(section, 1)) "
    "select ask.q_id, count(h.path) as n, count(h.path) filter (where h.section_number <> ask.section) as n_bad, coalesce(list(distinct h.section_number order by h.section_number) filter (where h.section_number <> ask.section), []) as bad_sections, count(h.path) > 0 and count(h.path) filter (where h.section_number <> ask.section) = 0 as sound from ask left join h on h.q_id = ask.q_id group by ask.q_id, ask.section"
)
def section_integrity(spark, d):
    asked, ch = _own(spark, d), chunks(spark, d)
    hits = asked.withColumn("major", F.substring(F.regexp_replace("section", "[^0-9]", ""), 1, 1)).join(ch.withColumn("major", F.substring("section_number", 1, 1)), ["path", "major"])
    return route.section_integrity(asked, hits).select("q_id", "n", "n_bad", "bad_sections", "sound")

"""Which source and which section a question asks for, as Column expressions.

A phrase that names a source is looked for by seven rules in turn; the first whose capture is a name, and no mere
wording of a request, gives it. Word borders are those of ASCII letters, digits and underscores.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import GAP as S
from .names import GAPS, STOP_WORDS, once, plain_name, split_name, strip

#: Words of conversation that are no part of a name.
FILLER = (
    "about", "again", "can", "could", "create", "explain", "for", "how", "it", "lecture", "lesson", "make", "me", "more", "please", "presentation",
    "say", "section", "slide", "slides", "summarize", "summary", "talk", "talks", "teach", "tell", "that", "this", "what", "would", "you",
)
#: Verbs with which a request begins.
VERBS = ("build", "create", "explain", "generate", "give", "make", "prepare", "summarize", "teach", "tell", "write")
NOUN = "(?:book|pdf|note|document|file)"
SAY = "(?:says?|talks?|covers?|mentions?)"
_FROM, _TO = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# Before a sign that is no letter, a word border asks for a word.
_SECTION = rf"(?:{_FROM}(?:section|sec\.?)|(?<=[A-Za-z0-9_])§){S}*\d+(?:\.\d+){{1,4}}"
_NUMBERED = rf"(?:section|sec\.?|§){S}*\d+(?:\.\d+){{1,4}}{_TO}"

RULES = (
    rf"(?i){_FROM}(?:my|the){S}+(.{{4,180}}?){S}+{NOUN}{_TO}",
    rf"(?i){_SECTION}{_TO}[^?.!]{{0,120}}?{_FROM}(?:in|from|of){S}+(?:(?:my|the){S}+)?(.+?)(?:{S}+{NOUN})?(?:[?.!]|\z)",
    rf"(?i){_SECTION}{S}+(?:of|from|in){S}+(.+?)(?:[?.!]|\z)",
    rf"(?i)^{S}*(?:can{S}+you{S}+)?what{S}+does{S}+(?:(?:my|the){S}+{NOUN}{S}+)?(.+?){S}+{SAY}{_TO}",
    rf"(?i)^{S}*(?:in|from|according{S}+to){S}+(?:(?:my|the){S}+)?(.+?)(?:,{S}*|{S}+)(?:(?:what{S}+(?:does|is)|section|sec|explain|summarize|create|make|teach|tell){_TO}|(?:sec\.|§)(?=[A-Za-z0-9_]))",
)
BEFORE_SECTION = rf"(?i)^(.+?){S}+{_NUMBERED}"
FRAMES = (
    rf"(?i)^(?:(?:can|could|would){S}+you{S}+)?(?:please{S}+)?(?:create|make|write|build|generate|give|prepare|explain|summarize|teach|tell){_TO}",
    rf"(?i)^(?:what|how){S}+(?:about|does|do|is|are){_TO}",
)
#: Wordings that stand before a name, any number of them.
LEADS = (
    rf"(?:can|could|would){S}+you{S}+(?:please{S}+)?",
    rf"please{S}+",
    rf"(?:create|make|write|build|generate|give|prepare){S}+(?:me{S}+)?(?:a{S}+)?(?:lecture|lesson|presentation|slides?|slide{S}+deck){S}+(?:about|on|for|from)?{S}*",
    rf"(?:explain|summarize|teach|tell{S}+me{S}+about){S}+",
    rf"(?:what{S}+does|what{S}+do|what{S}+is{S}+in|according{S}+to|from|in){S}+",
)


def is_framing(text: Column) -> Column:
    """Whether a text only words a request. Letters with accents count whole here."""
    def worded(words: Column) -> Column:
        return ~F.exists(words, lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS, *FILLER)) | F.get(words, F.lit(0)).isin(*VERBS)

    split = lambda t: F.filter(F.split(plain_name(split_name(t)), " "), lambda x: x != "")
    return once(F.rtrim(strip(text), F.lit(",:;.!?")), lambda t: (t == "") | t.rlike(FRAMES[0]) | t.rlike(FRAMES[1]) | once(split(t), worded))


def strip_framing(text: Column) -> Column:
    """Without the wordings of a request before a name."""
    return strip(F.regexp_replace(strip(text), "(?i)^(?:" + S + "*(?:" + "|".join(LEADS) + "))+", ""))


def clean_phrase(text: Column) -> Column:
    """Without quotes, final punctuation, my or the before it and a document noun behind it."""
    t = F.rtrim(F.ltrim(text, F.lit(GAPS + "\"'`")), F.lit(GAPS + "\"'`,:;"))
    return strip(F.regexp_replace(F.regexp_replace(t, rf"(?i)^(?:my|the){S}+", ""), rf"(?i){S}+{NOUN}{S}*\z", ""))


def requested_source_phrase(question: Column) -> Column:
    """The name of the source that a question asks about; null if it names none. A rule is tried only where those before it found no name and where
    the words that it cannot do without are there, and what is used more than once is bound, as nothing is shared within lambdas."""
    name = lambda raw: once(raw, lambda r: F.when(r != "", once(clean_phrase(r), lambda x: F.when((F.length(x) >= 4) & ~is_framing(x), x))))

    def before(q: Column) -> Column:
        return once(F.regexp_extract(q, BEFORE_SECTION, 1), lambda raw: F.when((raw != "") & ~is_framing(raw), strip_framing(raw)).otherwise(""))

    def last(q: Column, section: Column, says: Column) -> Column:
        worded = F.regexp_replace(q, rf"(?is)(?:{_FROM}(?:section|sec\.?){S}+\d+(?:\.\d+){{1,4}}{_TO}).*\z", "")
        cut = F.when(section, once(worded, lambda c: F.when(c != q, c).otherwise(F.regexp_replace(q, rf"(?is)§{S}*\d+(?:\.\d+){{1,4}}{_TO}.*\z", "")))).otherwise(q)
        unsaid = lambda t: F.when(says, F.regexp_replace(t, rf"(?i){S}+{SAY}{_TO}.*\z", "")).otherwise(t)
        bare = lambda t: once(F.regexp_replace(strip_framing(t), rf"(?i)^{S}*(?:(?:my|the){S}+)?{NOUN}{S}+", ""), unsaid)
        return once(strip(F.rtrim(cut, F.lit("?!."))), lambda t: F.when(is_framing(t), "").otherwise(bare(t)))

    def ruled(q: Column, low: Column) -> Column:
        has = lambda *words: reduce(or_, [F.contains(low, F.lit(w)) for w in words])
        begins = lambda *words: reduce(or_, [F.startswith(low, F.lit(w)) for w in words])
        section = has("sec", "§")
        needed = has("book", "pdf", "note", "document", "file") & has("my", "the"), section, section, begins("what", "can"), begins("in", "from", "according")
        tried = [F.when(n, name(F.regexp_extract(q, r, 1))) for n, r in zip(needed, RULES, strict=True)]
        return F.coalesce(*tried, F.when(section, name(before(q))), name(last(q, section, has("say", "talk", "cover", "mention"))))

    return once(strip(question), lambda q: once(F.lower(q), lambda low: ruled(q, low)))


def section_request(question: Column) -> Column:
    """The section number that a question names explicitly; null if none."""
    worded = F.regexp_extract(question, rf"(?i){_FROM}(?:section|sec\.?){S}+(\d+(?:\.\d+){{1,4}}){_TO}", 1)
    signed = F.regexp_extract(question, rf"§{S}*(\d+(?:\.\d+){{1,4}}){_TO}", 1)
    return F.coalesce(F.nullif(worded, F.lit("")), F.nullif(signed, F.lit("")))


def same_section(number: Column) -> Column:
    """A section number for comparison: without signs, white space and final dots."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(number, F.lit("")), rf"§|{S}", ""), r"\.+\z", "")


def is_lecture_request(question: Column) -> Column:
    """Whether a question asks for slides, a lecture or a lesson to be made."""
    q = F.lower(strip(F.regexp_replace(question, f"{S}+", " ")))
    shows = r"(?:lecture|lesson|presentation|slides?|slide deck)"
    made = rf"{_FROM}(?:create|make|build|generate|write|prepare|give|produce){_TO}.{{0,80}}{_FROM}{shows}{_TO}"
    on = rf"{_FROM}{shows}{_TO}.{{0,50}}{_FROM}(?:for|from|on|about|using){_TO}"
    kinds = rf"{_FROM}(?:lecture|class|teaching) slides?{_TO}|{_FROM}slide[ -]*by[ -]*slide{_TO}"
    return q.rlike(f"{made}|{on}|{kinds}")

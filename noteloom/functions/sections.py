"""Lines of pages: numbered sections, chapters and headings in capitals. What is asked of every line of a page are plain functions for Arrow batches,
the rest are Column expressions. Patterns mean the same in both: digits, blanks of \\s and case are those of ASCII."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import GAP as S
from .names import once, strip

#: The characters of ``GAP`` but the blank, and a character that a dot stands for.
ODD_GAPS = "\t\n\x0b\f\r\xa0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_DOT = r"[^\n\r\x85\u2028\u2029]"
_GAP = re.compile(f"[ {ODD_GAPS}]+")

# For lines whose gaps are single blanks.
_NUMBER = r"(\d+(?: ?\. ?\d+){1,4})\.?"
_NUMBER_AND_TITLE = re.compile(rf"(?:section )?{_NUMBER} ({_DOT}+)\Z", re.I | re.A)
_NUMBER_ONLY = re.compile(rf"(?:section )?{_NUMBER}\Z", re.I | re.A)
_MAJOR, _MINOR, _MINOR_AND_TITLE = (re.compile(x, re.A) for x in (r"(\d+)\.\Z", r"(\d+)\.?\Z", rf"(\d+)\.? ({_DOT}+)\Z"))
_CHAPTER = re.compile(rf"chapter (?:\d+|[ivxlcdm]+)(?![A-Za-z0-9_]){_DOT}{{0,160}}\Z", re.I | re.A)
_TOC = re.compile(r"(?:\.{3,}|…{2,}) ?\d{1,4}\Z", re.A)
_PAGE = re.compile(r" \d{1,4}\Z", re.A)
_MARK = re.compile(r" ?[-–—:] ?")
_CAPITAL = re.compile("[A-Z]")
_DIGITS = frozenset("0123456789")


def single_gaps(line: str) -> str:
    """Without gaps at its ends, and single blanks for those within."""
    return _GAP.sub(" ", line).strip(" ")


def normalize_section(number: Column) -> Column:
    """Without white space and one final dot."""
    return F.regexp_replace(F.regexp_replace(number, S, ""), r"\.\z", "")


def same_key(number: Column) -> Column:
    """The key by which chunks of a section are found; __none__ where there is no number."""
    return F.when(F.coalesce(number, F.lit("")) == "", "__none__").otherwise(normalize_section(number))


def is_toc_entry(line: Column) -> Column:
    """Dots (three or more) or ellipses (two or more), then a page number of up to four digits."""
    return line.rlike(rf"(?:\.{{3,}}|…{{2,}}){S}*\d{{1,4}}{S}*\z")


def clean_title(title: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(title, f"{S}+", " "), r"^\s*[-–—:]\s*", ""))


def is_section_title(title: Column) -> Column:
    """1 to 160 characters, at most 18 words, no contents entry, no page number at the end, the first letter no small one,
    and no sentence unless all in capitals."""
    return once(clean_title(title), _is_clean_title)


def _is_clean_title(t: Column) -> Column:
    return F.length(t).between(1, 160) & (F.size(F.split(t, " ")) <= 18) & ~is_toc_entry(t) & ~t.rlike(r"\s\d{1,4}\z") & ~t.rlike(r"^\P{L}*\p{Ll}") & (~t.rlike(r"[.!?]\z") | (t == F.upper(t)))


def _toc(line: str) -> bool:
    """``is_toc_entry`` of a line with single blanks."""
    return line[-1:] in _DIGITS and _TOC.search(line) is not None


def _clean(title: str) -> str:
    """``clean_title`` of a title with single blanks."""
    mark = _MARK.match(title)
    return (title[mark.end() :] if mark else title).strip(" ")


def _titled(number: str, title: str, consumed: int) -> tuple[str, str, int] | None:
    """A section, if its title is one by the rules of ``is_section_title``."""
    t = _clean(title)
    if not 1 <= len(t) <= 160 or t.count(" ") > 17 or _toc(t) or _PAGE.search(t) or (t[-1] in ".!?" and t != t.upper()):
        return None
    letter = next((c for c in t if c.isalpha()), "")
    return None if letter and unicodedata.category(letter) == "Ll" else (number, t, consumed)


def is_generic_heading(line: str) -> bool:
    """A line of 4 to 100 characters in capitals that ends no sentence and is no contents entry."""
    return 4 <= len(line) <= 100 and line[-1] not in ".!?" and _CAPITAL.search(line) is not None and line == line.upper() and not _toc(line)


def chapter_heading(line: str) -> str | None:
    return line if line[0] in "cC" and _CHAPTER.match(line) else None


def section_heading(number: str, title: str) -> str:
    return f"{number} {title}" if title else f"Section {number}"


def detect_section(line: str, second: str, third: str) -> tuple[str, str, int] | None:
    """(number, title, lines consumed) of a section that begins at a line, from it and the next two of its page (empty past
    the end); None if none does. A section is a number and a title on one line, a number and then a title, or a major number, a minor one and a title."""
    # Only a line that begins with a digit or the word can begin a section.
    if not (line[0] in _DIGITS or line[:3].lower() == "sec") or _toc(line):
        return None
    if (m := _NUMBER_AND_TITLE.match(line)) and (found := _titled(m[1].replace(" ", ""), m[2], 1)):
        return found
    if (m := _NUMBER_ONLY.match(line)) and (found := _titled(m[1].replace(" ", ""), second, 2)):
        return found
    if major := _MAJOR.match(line):
        if minor := _MINOR.match(second):
            return _titled(f"{major[1]}.{minor[1]}", third, 3)
        if m := _MINOR_AND_TITLE.match(second):
            return _titled(f"{major[1]}.{m[1]}", m[2], 2)
    return None


def needs_space(before: Column, after: Column) -> Column:
    """Whether two pieces of one line are parted by a blank: not after a hyphen or an opening bracket, nor before closing punctuation."""
    return ~(F.right(before, F.lit(1)).isin("-", "(", "[", "{") | F.left(after, F.lit(1)).isin(*",.;:!?%)]}"))

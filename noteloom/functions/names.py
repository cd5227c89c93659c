"""Names of sources: normal forms, tokens and likeness, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no meaning in a name.
STOP_WORDS = ("a", "an", "and", "book", "document", "file", "in", "my", "note", "of", "on", "pdf", "source", "the")

#: White space by Unicode, which Java's \s lacks. What is below U+1680 is told from letters by one look-up, and not compared with each of the others.
GAP = r"[ \t\n\x0B\f\r\x{a0}[\x{1680}-\x{feff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"
#: The characters of ``GAP``.
GAPS = " \t\n\x0b\f\r\xa0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas, where common parts are not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends. Trimmed, as a pattern would look for an end at every character."""
    return F.btrim(text, F.lit(GAPS))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def split_name(name: Column) -> Column:
    """Camel case, underscores, slashes and hyphens become separate words; the extension goes."""
    t = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)\.(?:md|pdf)\z", ""), r"[_\\/\-]+", " ")


def plain_name(split: Column) -> Column:
    """Lower-case words of letters, digits and dots, without final version, size, final, copy or scan words; one word always stays."""
    t = F.trim(F.regexp_replace(F.lower(split), r"[^\p{L}\p{N}.]+", " "))
    return F.regexp_replace(t, r"(?: (?:v?\d+(?:\.\d+)+|\d+(?:\.\d+)?x\d+(?:\.\d+)?|final|copy|scan))+\z", "")


def normalize_name(name: Column, decompose: bool = True) -> Column:
    """A name for matching. With ``decompose`` accents come apart from their letters and become blanks (one Arrow batch
    function, there is no built-in one); without it accented letters stay whole, and all runs in the JVM."""
    split = split_name(name)
    return plain_name(_decomposed(split) if decompose else split)


def significant_tokens(normal: Column) -> Column:
    """Words of three letters or more that are no stop words."""
    return F.filter(F.split(normal, " "), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS))


def canonical_token(token: Column) -> Column:
    """A word's stem: computer words are one, a final s goes. A word without any ASCII letter or digit stays as it is."""
    stem = lambda t: F.when(t == "", token).when(t.startswith("comput"), "comput").when((F.length(t) > 5) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return once(F.regexp_replace(F.lower(token), "[^a-z0-9]", ""), stem)


def canonical_tokens(normal: Column) -> Column:
    return F.transform(significant_tokens(normal), canonical_token)


def canonical_phrase(normal: Column) -> Column:
    return F.array_join(canonical_tokens(normal), " ")


def token_class(stem: Column) -> Column:
    """Stems are equivalent if they are equal or if both have six letters and share the first six: if this is equal."""
    return F.substring(stem, 1, 6)


def tokens_equivalent(a: Column, b: Column) -> Column:
    return token_class(canonical_token(a)) == token_class(canonical_token(b))


def token_dice(a: Column, b: Column) -> Column:
    """Dice likeness of two arrays of stems, matched one to one; 0 if either is empty. As equivalence is by class, the largest matching is the sum of common counts."""
    left, right = F.transform(a, token_class), F.transform(b, token_class)
    common = F.aggregate(F.array_distinct(left), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(left, lambda y: y == x)), F.size(F.filter(right, lambda y: y == x))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix in the shorter one's; 0 if that is empty."""
    short = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), short), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(short == 0, 0.0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, short) / short)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def name_score(asked: Column, asked_stems: Column, name: Column, name_stems: Column) -> Column:
    """How well a normalised name fits the asked one, 0 to 100; names under four characters do not count."""
    edit, dice, prefix = edit_similarity(asked, name), token_dice(asked_stems, name_stems), common_prefix(asked, name)
    stems = F.when((F.size(asked_stems) > 0) & (F.array_join(asked_stems, " ") == F.array_join(name_stems, " ")), 99.0).otherwise(0.0)
    short, long = F.least(F.length(asked), F.length(name)), F.greatest(F.length(asked), F.length(name))
    inside = F.when(F.contains(asked, name) | F.contains(name, asked), 90 + 10 * short / long).otherwise(0.0)
    best = F.greatest(stems, inside, edit * 100, dice * 96, (edit * 0.35 + dice * 0.5 + prefix * 0.15) * 100)
    return F.when(F.length(name) < 4, 0.0).when(asked == name, 100.0).otherwise(F.least(best, F.lit(100.0)))


def search_terms(normal: Column) -> Column:
    """Up to twelve terms that find a name: itself, its words, their stems of four letters or more, and six-letter starts; longest first, then in this order."""

    def found(words: Column) -> Column:
        return once(F.filter(F.transform(words, canonical_token), lambda x: F.length(x) >= 4), lambda stems: F.concat(words, stems, F.transform(F.filter(stems, lambda x: F.length(x) >= 6), lambda x: F.substring(x, 1, 6))))

    each = lambda n: F.filter(F.array_distinct(F.concat(F.array(n), once(significant_tokens(n), found))), lambda x: x != "")
    keyed = F.array_sort(F.transform(once(normal, each), lambda x, i: F.struct((-F.length(x)).alias("k"), i.alias("i"), x.alias("x"))))
    return F.slice(F.transform(keyed, lambda s: s["x"]), 1, 12)

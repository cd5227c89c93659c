"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "\n\n[... middle of the text left out here ...]\n"


def strip_frontmatter(text: Column) -> Column:
    """CRLF becomes LF; a block between a first line --- and the next line --- goes. Unclosed: unchanged."""
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    end = F.locate("\n---\n", t, 5)
    return F.when(F.startswith(t, F.lit("---\n")) & (end > 0), F.substring(t, end + 5, F.length(t))).otherwise(t)


def truncate(text: Column, most: int) -> Column:
    """Up to ``most`` characters: the head (65 %), a marker and the tail; a plain prefix if ``most`` is at most 80."""
    if most <= 80:
        return F.substring(text, 1, most)
    room = most - len(MARKER)
    head = -(-room * 65 // 100)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(MARKER), F.right(text, F.lit(room - head))))


def truncate_to(text: Column, most: Column) -> Column:
    """``truncate`` to a length of each row's own."""
    room = most - len(MARKER)
    head = F.ceil(room * 65 / 100).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), head), F.lit(MARKER), F.right(text, room - head))
    return F.when(F.length(text) <= most, text).when(most <= 80, F.substring(text, F.lit(1), most)).otherwise(cut)


def conversation_title(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", "New chat").when(F.length(t) <= 48, t).otherwise(F.concat(F.substring(t, 1, 45), F.lit("...")))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")

"""Tags, links and properties of notes.

The grammar is this engine's own: tags are those of the frontmatter's ``tags`` and inline #tags outside fences; links are
[[wikilinks]], ![[embeds]] and [text](target)s of the body, then the wikilinks of the frontmatter.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .names import strip

_FENCED = r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z)"


def frontmatter(text: Column) -> Column:
    """The lines between a first line --- and the next line ---; '' without such a block."""
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    end = F.locate("\n---\n", t, 4)
    return F.when(F.startswith(t, F.lit("---\n")) & (end > 4), F.substring(t, F.lit(5), end - 5)).otherwise("")


def tags(text: Column, body: Column) -> Column:
    """Tags without their sign, each once, the frontmatter's first. text: the note; body: the note without its frontmatter."""
    line = F.regexp_extract(frontmatter(text), r"(?m)^tags:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
    listed = F.regexp_extract(frontmatter(text), r"(?m)^tags:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1)
    front = F.concat(F.split(line, ","), F.split(F.regexp_replace(listed, r"(?m)^[ \t]*-", ","), ","))
    inline = F.regexp_extract_all(F.regexp_replace(body, _FENCED, ""), F.lit(r"(?:^|\s)#([\p{L}_][\p{L}\p{N}_/-]*)"), F.lit(1))
    bare = lambda x: F.regexp_replace(strip(x), r"^[\"']?#?|[\"']\z", "")
    return F.array_distinct(F.filter(F.concat(F.transform(front, bare), inline), lambda x: x != ""))


def links(text: Column, body: Column) -> Column:
    """Targets without alias and heading, each once: the body's wikilinks, embeds and Markdown links as they stand, then the frontmatter's."""
    wiki = r"!?\[\[([^\]|#\n]+)[^\]\n]*\]\]"
    bare = F.regexp_replace(body, _FENCED, "")
    plain, embeds = F.regexp_extract_all(bare, F.lit(r"(?<!!)\[\[([^\]|#\n]+)[^\]\n]*\]\]"), F.lit(1)), F.regexp_extract_all(bare, F.lit(r"!\[\[([^\]|#\n]+)[^\]\n]*\]\]"), F.lit(1))
    marked = F.regexp_extract_all(bare, F.lit(r"(?<!!)\[[^\]\n]*\]\(([^()\s]+)\)"), F.lit(1))
    front = F.regexp_extract_all(frontmatter(text), F.lit(wiki), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(plain, marked, embeds, front), strip), lambda x: x != ""))


def _flat(key: str, value: object, out: list[str]) -> None:
    todo = [(key, value)]  # a stack of its own, as values may be nested deeper than calls
    while todo:
        key, value = todo.pop()
        if isinstance(value, list):
            todo.extend((key, x) for x in reversed(value))
        elif isinstance(value, dict):
            todo.extend((f"{key}.{k}", x) for k, x in reversed(value.items()))
        elif value is not None:
            out.append(f"{key}={str(value).lower() if isinstance(value, bool) else value}")


@F.pandas_udf(ArrayType(StringType()))
def properties(frontmatter_json: pd.Series) -> pd.Series:
    """Frontmatter as a JSON object to key=value texts of any depth: keys of inner objects after a dot, a text for each item of a list. Nulls and the key ``position`` go;
    what is no JSON object has none. There is no built-in function for objects of unknown depth, so this is an Arrow batch function."""

    def of(text: str | None) -> list[str]:
        try:
            value = json.loads(text or "")
        except ValueError:
            return []
        out: list[str] = []
        for key, x in value.items() if isinstance(value, dict) else ():
            if key != "position":
                _flat(key, x, out)
        return out

    return frontmatter_json.map(of)

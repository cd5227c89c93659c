"""Functions that the JVM's built-ins lack: the portable vector codec and maths delimiters, over Arrow batches."""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
#: A code span up to the same number of backticks or the line's end, or a delimiter that no backslash precedes.
_SPAN_OR_DELIMITER = re.compile(r"(?P<ticks>(?<!`)`+(?!`)).*?(?:(?<!`)(?P=ticks)(?!`)|$)|(?<!\\)\\(?P<delimiter>[()\[\]])")
_DOLLARS = {"(": "$", ")": "$", "[": "$$", "]": "$$"}


@pandas_udf(StringType())
def encode_f32(vectors: pd.Series) -> pd.Series:
    """Base64 of little-endian 32-bit floats; null stays null."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


@pandas_udf(ArrayType(FloatType()))
def decode_f32(encoded: pd.Series) -> pd.Series:
    """The inverse of ``encode_f32``; a length that is no multiple of four bytes is an error."""

    def one(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        raw = base64.b64decode(text)
        if len(raw) % 4:
            raise ValueError("vector payload of an invalid length")
        return np.frombuffer(raw, "<f4")

    return encoded.map(one)


def dollars(text: str | None) -> str | None:
    """Maths in brackets after a backslash becomes maths between dollar signs, outside of code spans and fences."""
    if text is None:
        return None
    swap = lambda m: _DOLLARS[m["delimiter"]] if m["delimiter"] else m[0]
    fence, out = "", []
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                fence = ""
            out.append(line)
        elif mark:
            fence = mark[1]
            out.append(line)
        else:
            out.append(_SPAN_OR_DELIMITER.sub(swap, line))
    return "\n".join(out)


@pandas_udf(StringType())
def normalize_math(texts: pd.Series) -> pd.Series:
    return texts.map(dollars)

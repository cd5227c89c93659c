"""Embedding of texts by a pluggable model, and pooling of token vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import unit

#: Fixed value: tokens that a text keeps, its last one among them.
MAX_TOKENS = 256


class Embedder(Protocol):
    """A model that gives each text a vector of ``dimensions`` numbers. It is pickled to the workers and should load its weights at first use."""

    identity: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def kept_tokens(tokens: list[str], most: int = MAX_TOKENS) -> list[str]:
    """At most ``most`` tokens: the first ones and the last one."""
    return tokens if len(tokens) <= most else [*tokens[: most - 1], tokens[-1]]


class HashedEmbedder:
    """A model without weights, for tests and offline runs: each word has a fixed random vector, a text the unit mean of its words'."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.identity = dimensions, f"hashed-words-{dimensions}-mean-l2"
        self._words: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        if len(self._words) > 1 << 16:
            self._words.clear()
        if word not in self._words:
            self._words[word] = np.random.default_rng(zlib.crc32(word.encode())).standard_normal(self.dimensions)
        return self._words[word]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = kept_tokens(text.lower().split())
            mean = np.mean([self._word(w) for w in words], 0) if words else np.zeros(self.dimensions)
            norm = np.linalg.norm(mean)
            out.append((mean / norm if norm else mean).astype(np.float32).tolist())
        return out


def embedded(rows: DataFrame, model: Embedder, text: str = "embedding_text", vector: str = "embedding", each: int = 64) -> DataFrame:
    """``rows`` with the vectors of a column's texts, ``each`` at a time, in their order. A model that gives more or fewer vectors than it
    got texts, or one of another width, ends the job with an error. Null texts are embedded as empty ones."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{vector}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, vectors = batch[text].fillna("").tolist(), []
            for lo in range(0, len(texts), each):
                some = texts[lo : lo + each]
                got = model.embed(some)
                if len(got) != len(some) or any(len(v) != model.dimensions for v in got):
                    raise ValueError(f"the model gave {len(got)} vectors for {len(some)} texts, or one that has not {model.dimensions} numbers")
                vectors += got
            yield batch.assign(**{vector: pd.Series(vectors, index=batch.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def mean_pooled(tokens: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """The unit mean of the vectors of each key. Sums are made within each task before the shuffle, one aggregate for each of the dimensions."""
    means = [F.avg(F.element_at(vector, i + 1).cast("double")).alias(f"m{i}") for i in range(dimensions)]
    pooled = tokens.groupBy(key).agg(*means).select(key, F.array(*[F.col(f"m{i}") for i in range(dimensions)]).alias("mean"))
    return pooled.select(key, F.coalesce(unit(F.col("mean")), "mean").alias(vector))

"""Models behind a server: options of a request, the catalogue's renewal, leases, and adapters that take the sending function.

Nothing here opens a connection: ``Send`` is given by the caller, as a picklable function of a path and a JSON-like
value. Without one the engine runs on ``HashedEmbedder`` and ``PromptOnly``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Send = Callable[[str, dict], dict]


# ---------------------------------------------------------------- options and catalogue


def chat_options(lecture: Column, model: Column, effort: str = "low", lecture_thinking: bool = False, keep_alive: str = "", threads: int = 0, batch: int = 0, chat_context: int = 0, lecture_context: int = 0) -> Column:
    """struct(think, keep_alive, num_thread, num_batch, num_ctx) of a request; null leaves a value to the server. How a model thinks depends on its family."""
    low = F.lower(model)
    think = F.when(F.contains(low, F.lit("gpt-oss")), effort).when(F.contains(low, F.lit("qwen3")), F.when(lecture, str(lecture_thinking).lower()).otherwise("true")).otherwise(effort)
    some = lambda n: F.lit(n if n > 0 else None).cast("int")
    context = F.when(lecture, some(lecture_context)).otherwise(some(chat_context))
    return F.struct(think.alias("think"), F.lit(keep_alive.strip() or None).cast("string").alias("keep_alive"), some(threads).alias("num_thread"), some(batch).alias("num_batch"), context.alias("num_ctx"))


def renewed_catalog(old: DataFrame, listed: DataFrame, details: DataFrame, asked: str, now: str) -> DataFrame:
    """The catalogue (server, name, capabilities, error) after a listing (name) of the server ``asked`` and what was said of each model (name, capabilities, error).

    A model that could not be looked into stays, with its error and no capabilities. If the server is another one ``now``, the listing is
    thrown away and so is the old catalogue; an empty listing because of an error is the caller's not to pass on.
    """
    if asked != now:
        return old.limit(0)
    said = details.groupBy("name").agg(F.max_by(F.struct("capabilities", "error"), F.when(F.col("error").isNull(), 1).otherwise(0)).alias("d"))
    rows = listed.select("name").distinct().join(said, "name", "left")
    return rows.select(F.lit(now).alias("server"), "name", F.when(F.col("d.error").isNull(), F.col("d.capabilities")).alias("capabilities"), F.when(F.col("d").isNull(), "no answer").otherwise(F.col("d.error")).alias("error"))


# ---------------------------------------------------------------- leases


class Leases:
    """Which models are in use. A model is unloaded when nobody holds it; until then the wish waits, and new holders are turned away."""

    def __init__(self, unload: Callable[[str], None]):
        self._unload, self._lock = unload, threading.Lock()
        self._held: dict[str, int] = {}
        self._waiting: set[str] = set()

    @contextmanager
    def hold(self, *models: str) -> Iterator[None]:
        names = sorted({m for m in models if m})
        with self._lock:
            pending = [m for m in names if m in self._waiting]
            if pending:
                raise RuntimeError(f"{pending[0]} is about to be unloaded")
            for m in names:
                self._held[m] = self._held.get(m, 0) + 1
        try:
            yield
        finally:
            for m in names:
                with self._lock:
                    self._held[m] -= 1
                    free = not self._held[m] and m in self._waiting
                if free:
                    self._drop(m)

    def unload(self, model: str) -> bool:
        """Unloads a model, or leaves it to the last holder; returns whether it is gone."""
        with self._lock:
            self._waiting.add(model)
            free = not self._held.get(model)
        if free:
            self._drop(model)
        return free

    def _drop(self, model: str) -> None:
        try:
            self._unload(model)
        finally:
            with self._lock:
                self._waiting.discard(model)


# ---------------------------------------------------------------- adapters


class ServedEmbedder:
    """An ``Embedder`` behind a server."""

    def __init__(self, send: Send, model: str, dimensions: int):
        self.send, self.model, self.dimensions, self.identity = send, model, dimensions, f"served-{model}-{dimensions}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.send("/api/embed", {"model": self.model, "input": list(texts)})["embeddings"] if texts else []


class ServedGenerator:
    """A ``Generator`` behind a server: one request for each prompt, from the tasks."""

    def __init__(self, send: Send, model: str):
        self.send, self.model = send, model

    def answer(self, prompts: DataFrame) -> DataFrame:
        send, model = self.send, self.model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ask = lambda s, u: send("/api/chat", {"model": model, "stream": False, "messages": [{"role": "system", "content": s}, {"role": "user", "content": u}]})
                yield pd.DataFrame({"q_id": b["q_id"], "answer": [ask(s, u)["message"]["content"] for s, u in zip(b["system"], b["user"], strict=True)]})

        kind = prompts.schema["q_id"].dataType.simpleString()
        return prompts.select("q_id", "system", "user").mapInPandas(run, f"q_id {kind}, answer string")


def token_vectors(outputs: dict[str, np.ndarray]) -> np.ndarray:
    """Of a model's outputs the one with a vector for each token: the last hidden state, or else the first of three dimensions."""
    if "last_hidden_state" in outputs:
        return outputs["last_hidden_state"]
    found = next((v for v in outputs.values() if v.ndim == 3), None)
    if found is None:
        raise ValueError("the model gives no vectors of tokens")
    return found


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit means over the tokens that the mask keeps."""
    weight = mask[:, :, None].astype(np.float64)
    mean = (vectors * weight).sum(1) / np.maximum(weight.sum(1), 1)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.divide(mean, norm, out=np.zeros_like(mean), where=norm > 0)

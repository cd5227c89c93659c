"""Settings of the engine with their defaults and hard limits."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    top_k: int = 8
    vector_weight: float = 0.55
    min_similarity: float = 0.35
    index_pdf: bool = True
    chunk_target: int = 2800
    chunk_max: int = 4200
    context_chunks: int = 6
    context_chars: int = 18_000
    lecture_chunks: int = 8
    lecture_chars: int = 12_000
    history_chars: int = 2_000
    debounce_ms: int = 1_400
    persist_ms: int = 2_200
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    only_sources: bool = True
    chat_model: str = ""
    lecture_model: str = ""

    @property
    def text_weight(self) -> float:
        return round(1 - min(1.0, max(0.0, self.vector_weight)), 2)

    @property
    def lecture_chunk_limit(self) -> int:
        return _setting(self.lecture_chunks, 1, 12, 8)

    @property
    def lecture_char_limit(self) -> int:
        return _setting(self.lecture_chars, 4_000, 30_000, 12_000)

    @property
    def history_char_limit(self) -> int:
        return _setting(self.history_chars, 0, 12_000, 2_000, zero=True)


def _setting(value: float, least: int, most: int, otherwise: int, zero: bool = False) -> int:
    """A setting's whole part within limits; ``otherwise`` if it is no number or not positive (with ``zero``: negative)."""
    if not math.isfinite(value) or math.trunc(value) < (0 if zero else 1):
        return otherwise
    return max(least, min(most, math.trunc(value)))

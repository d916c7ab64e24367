"""Every tunable of the engine, validated."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults for production; `small()` gives the limits that short conversations exercise."""

    dim: int = 64
    similarity_threshold: float = 0.45
    min_turns: int = 2
    max_turns: int = 20
    window: int = 3
    micro_tokens: int = 60
    meso_tokens: int = 200
    macro_tokens: int = 400
    hot_turns: int = 10
    top_k: int = 5
    recency_boost: float = 0.2
    keyword_weight: float = 0.15
    context_tokens: int = 2048

    def __post_init__(self) -> None:
        if min(self.dim, self.min_turns, self.max_turns, self.window, self.hot_turns, self.top_k) < 1:
            raise ValueError("sizes and counts must be positive")
        if not -1 <= self.similarity_threshold <= 1:
            raise ValueError("a similarity threshold lies between -1 and 1")

    @staticmethod
    def small() -> Config:
        return Config(max_turns=4, hot_turns=4, top_k=3, context_tokens=400)

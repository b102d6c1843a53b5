"""Options of a pipeline run (API-18)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    min_raw_count: int = 2
    top_k: int = 50
    fuzzy: bool = True
    relaxed_min_plays: int = 10
    max_shared_df: int | None = None
    min_jaccard: float = 0.1
    acoustic_threshold: float = 0.98
    pagerank_rounds: int = 20
    betweenness_sources: int = 2000
    ratchet: float = 0.5
    min_artists: int = 1

    def __post_init__(self) -> None:
        if self.top_k < 0 or not 0 <= self.ratchet <= 1 or not 0 < self.min_jaccard <= 1:
            raise ValueError("top_k of at least 0, a ratchet of 0 to 1 and a min_jaccard above 0 and up to 1")

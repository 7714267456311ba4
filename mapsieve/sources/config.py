"""Declared limits of the search service."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ServiceLimits:
    similarity: float = 70.0
    max_results: int = 50
    cache_seconds: int = 3600
    max_files: int = 50

    def __post_init__(self):
        if not 0 <= self.similarity <= 100:
            raise ValueError("similarity must lie between 0 and 100")
        if not 1 <= self.max_results <= 200:
            raise ValueError("max_results must lie between 1 and 200")

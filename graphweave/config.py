"""Settings of the engine, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Chunking, validation and retrieval parameters; the defaults are those of the chunk-only ingest."""

    chunk_size_tokens: int = 512
    chunk_overlap_tokens: int = 64
    min_chunk_tokens: int = 30
    top_k: int = 10
    graph_weight: float = 0.6
    vector_weight: float = 0.4
    context_tokens: int = 2500
    embedding_dimension: int = 64
    output_dir: str = "output"

    def __post_init__(self) -> None:
        if self.chunk_size_tokens <= 0:
            raise ValueError("the chunk size must be positive")
        if not 0 <= self.chunk_overlap_tokens < self.chunk_size_tokens:
            raise ValueError("the overlap must be at least 0 and less than the chunk size")

    @classmethod
    def full_ingest(cls) -> EngineConfig:
        """The parameters of the ingest that also extracts entities."""
        return cls(chunk_size_tokens=500, chunk_overlap_tokens=80)

    @classmethod
    def from_environment(cls) -> EngineConfig:
        """Fields from upper-case environment variables of the same name; unset, empty and 0 mean the default."""
        found = {}
        for field in fields(cls):
            value = os.environ.get(field.name.upper(), "")
            kind = type(field.default)
            if value and (kind is str or float(value) != 0):
                found[field.name] = kind(value)
        return cls(**found)

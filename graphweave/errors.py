"""Exceptions of the engine. Failures of single rows become ``error`` columns instead."""


class EngineError(Exception):
    """Root of all errors of the engine."""


class DocumentLoadError(EngineError):
    """A source is missing or of a kind that no loader reads."""


class ChunkingError(EngineError):
    """Parameters of the chunker that can give no chunks."""


class GenerationError(EngineError):
    """A text generator failed after all attempts."""


class EntityResolutionError(EngineError):
    """Entity resolution did not reach a fixpoint."""


class GraphConstructionError(EngineError):
    """Graph tables that break a key."""


class RetrievalError(EngineError):
    """A search that has no valid parameters."""

"""A Spark engine that turns document collections into a queryable knowledge graph."""

__version__ = "0.1.0"

"""loomgraph: document collections to a provenance-tracked knowledge graph, on PySpark."""

__all__ = ["session", "tables"]

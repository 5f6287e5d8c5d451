"""orrery: relation-aware search over frozen embeddings, expressed as Spark plans."""

__version__ = "0.1.0"

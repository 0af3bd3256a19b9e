"""Evidence retrieval over enriched document corpora, written as Spark plans."""

__version__ = "0.1.0"

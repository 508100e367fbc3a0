"""millrace: captured texts on Spark: canonical paths, redaction, deduplication, chunks and browsing."""

__version__ = "0.1.0"

"""lamina: document analytics on Spark DataFrames (clean, check, chunk, index, search, ingest)."""

__version__ = "0.1.0"

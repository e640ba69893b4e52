"""Nested-document analytics on Spark: documents to typed rows and back, search, versions, integrity."""

__version__ = "0.1.0"

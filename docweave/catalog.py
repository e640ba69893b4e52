"""Every query of the engine by name, with its SQL for the comparison against DuckDB."""

from __future__ import annotations

from docweave import catalog_documents, catalog_rows, catalog_search, catalog_store

_PARTS = (catalog_search, catalog_documents, catalog_rows, catalog_store)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

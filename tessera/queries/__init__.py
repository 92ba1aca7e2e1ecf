"""Catalogue of named queries: name -> (Spark function, DuckDB text or None)."""

from __future__ import annotations

from tessera.queries import forms, jobs, relations, research, scalars, search, selection, state
from tessera.queries.registry import CATALOG

__all__ = ["CATALOG", "forms", "jobs", "relations", "research", "scalars", "search", "selection", "state"]

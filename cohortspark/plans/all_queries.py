"""Importing this registers every query of the library."""

from __future__ import annotations

from cohortspark.plans import cohort_queries, language_queries, learning_queries, object_queries, source_queries, text_queries  # noqa: F401
from cohortspark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

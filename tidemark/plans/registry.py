"""All named queries over the test tables, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from tidemark.plans import articles, enrichment, features, indicators, landed, listings, models, reports, retrieval, settings, smart_money, stored, streams, tables, trends, usage, vector  # noqa: F401
from tidemark.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

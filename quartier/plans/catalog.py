"""Named queries over a data folder, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from . import model_queries, panel_queries, record_queries, scoring_queries, text_queries

QUERIES: dict = panel_queries.QUERIES | scoring_queries.QUERIES | text_queries.QUERIES | record_queries.QUERIES | model_queries.QUERIES
ORACLES: dict[str, str] = panel_queries.ORACLES | scoring_queries.ORACLES | text_queries.ORACLES | record_queries.ORACLES | model_queries.ORACLES

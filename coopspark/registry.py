"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from coopspark.plans import base, pipeline_queries, scalar_queries, stat_queries  # noqa: F401  (importing a module registers its queries)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)

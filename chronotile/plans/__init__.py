"""Queries of the library on the driver's tables, by name."""

from __future__ import annotations

from chronotile.plans import method_queries, pixel_queries, table_queries, tile_queries  # noqa: F401
from chronotile.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

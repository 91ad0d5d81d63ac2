"""All registered queries of the library."""

from __future__ import annotations

from . import catalog_adjusted, catalog_context, catalog_inference, catalog_panel, catalog_partitions, catalog_relational  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

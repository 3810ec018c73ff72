"""All registered queries and their check SQL."""

from __future__ import annotations

from tillwater.plans import baskets, forecasts, imports, relational, runs, scoring  # noqa: F401


def queries() -> dict:
    return dict(relational.QUERIES)


def oracle_sql() -> dict:
    return dict(relational.ORACLES)

"""All registered queries and their SQL."""

from __future__ import annotations

from chronolode.plans import forecasting, mining, tables, timelines, tree_fits, whole  # noqa: F401
from chronolode.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

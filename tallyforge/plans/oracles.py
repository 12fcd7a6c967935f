"""The same results in SQL, where SQL can say them."""

from __future__ import annotations

from tallyforge.plans import queries  # noqa: F401
from tallyforge.plans.catalog import SQL


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

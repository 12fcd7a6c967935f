"""All core queries, gathered from their modules."""

from __future__ import annotations

from tallyforge.plans import q_curation, q_files, q_joins, q_metrics, q_nested, q_parse, q_rules, q_streams  # noqa: F401
from tallyforge.plans.catalog import QUERIES, Query
from tallyforge.plans.q_metrics import latency_summary  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)

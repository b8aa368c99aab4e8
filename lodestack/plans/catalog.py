"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from lodestack.plans import conversations, documents, ingest, mutations, relational, retrieval, scalars, stateful  # noqa: F401
from lodestack.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

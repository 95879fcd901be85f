"""Names of all queries over the supplied tables, with the SQL that checks them."""

from __future__ import annotations

from .plans import functions, graph, ingest, more, ordered, register, retrieval, stores, timeline  # noqa: F401  (each registers its queries)


def queries() -> dict:
    return dict(register.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(register.ORACLES)

"""Registration of queries by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.adapters import duck

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def exact(sql: str, places: int) -> str:
    """SQL with every round(x, places) as the correctly rounded binary value, 0 without a sign."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, at + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        if sql[comma + 1 : end - 1].strip() == str(places) and not sql[at - 1 : at].isalnum():
            sql = f"{sql[:at]}(0 + CAST(printf('%.{places}f', CAST({sql[at + 6 : comma]} AS DOUBLE)) AS DOUBLE)){sql[end:]}"
        at += 4
    return sql


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add

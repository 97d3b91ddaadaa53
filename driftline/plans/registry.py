"""Query registry. Each entry is a Spark query and, where SQL can state it, an independent SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(sql: str) -> str:
    """Prefix the named table expressions a query uses, in definition order."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(CTES[name])

    visit(sql)
    body = sql.strip()
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in CTES if n in used)
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


# SQL text helpers for the twins.
def W(x: str) -> str:
    return f"(({x}) - 360.0*floor(({x})/360.0))"


def D(a: str, b: str) -> str:
    return f"((({a})-({b})+180.0) - 360.0*floor((({a})-({b})+180.0)/360.0) - 180.0)"


def R(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) AS {name}"

"""Registration of queries together with the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.testbed import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needed(sql: str, local: set[str]) -> list[str]:
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in CTES:
            if name in order or name in seen or name in local:
                continue
            if re.search(rf"\b(?:FROM|JOIN|IN)\s*\(?\s*{name}\b|,\s*{name}\b", text):
                visit(CTES[name], (*seen, name))
                order.append(name)

    visit(sql, ())
    return order


def build(sql: str) -> str:
    """Put the shared table definitions the SQL refers to in front of it."""
    sql = sql.strip()
    recursive = sql.startswith("WITH RECURSIVE ")
    head = "WITH RECURSIVE " if recursive else "WITH "
    local = set(re.findall(r"(?:WITH|WITH RECURSIVE|,)\s+(\w+)(?:\s*\([^()]*\))?\s+AS\s+(?:MATERIALIZED\s*)?\(", sql))
    shared = [f"{n} AS (\n{CTES[n]}\n)" for n in _needed(sql, local)]
    if not shared:
        return sql
    if sql.startswith(head):
        return head + ",\n".join(shared) + ",\n" + sql[len(head):]
    return head + ",\n".join(shared) + "\n" + sql


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a Testbed under an operator name."""

    def wrap(fn: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, directory: fn(Testbed(spark, directory))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def oracle_texts() -> dict[str, str]:
    return {name: build(sql) for name, sql in ORACLES.items()}

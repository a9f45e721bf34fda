"""Query registry: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from askloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(body: str, *needs: str) -> str:
    """Put the needed named subqueries, and what they need, in front of ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n][1]}\n)" for n in ordered)
    own = body.strip()
    joined = f",\n{own[5:]}" if own.startswith("WITH ") else f"\n{own}"
    return f"WITH RECURSIVE {parts}{joined}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *needs)
        return fn

    return add

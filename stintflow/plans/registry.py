"""All registered queries on the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stintflow.plans.roles import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def steady(sql: str) -> str:
    """sql with every round(x, n) as round((x) * 1.00000000001, n), as in rounded(): exact halves, which engines round
    differently, lie off the middle then."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, k, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        out += [sql[at:start], "round((", steady(sql[start + 6 : comma]), ") * 1.00000000001::DOUBLE", sql[comma:k]]
        at = k
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None, places: int = 5):
    """Register a function (spark, sf_dir) -> DataFrame under a name; its doubles are rounded for the comparison."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql:
            ORACLE_SQL[name] = steady(sql)
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from stintflow.plans import detail_queries, document_queries, fit_queries, lap_queries, ml_queries, quality_queries, stint_queries, strategy_queries  # noqa: F401


load()

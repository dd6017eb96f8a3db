"""Registry of queries, memo of staged analyses, and composition of check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import DataFrame, SparkSession

from depfleet.sources.tables import RELATIONS
from depfleet.staging import measured_joins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# name -> SQL of a common table expression used by check SQL; dependencies are read off the text
CTES: dict[str, str] = {name: sql for name, (_, sql) in RELATIONS.items()}

_memo: dict[tuple, object] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name relations and CTEs as tables."""
    def add(fn):
        @wraps(fn)
        def run(spark, sf):
            measured_joins(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


_REFERENCE = re.compile(r"\b(?:FROM|JOIN|IN)\s+\(?(\w+)", re.I)


@cache
def _references(sql: str) -> frozenset[str]:
    return frozenset(_REFERENCE.findall(sql))


def _needs(sql: str) -> list[str]:
    """Common table expressions a text reads, in order of definition."""
    named = _references(sql)
    return [n for n in CTES if n in named]


def compose(body: str) -> str:
    """``WITH RECURSIVE`` over everything the body needs, in order of dependency."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in _needs(CTES[name]):
            if other != name:
                visit(other)
        done.append(name)

    for name in _needs(body):
        visit(name)
    if not done:
        return body.strip()
    parts = []
    for name in done:
        recursive = name in _needs(CTES[name])
        parts.append(f"{name} AS {'' if recursive else 'MATERIALIZED '}(\n{CTES[name]}\n)")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()


def memo(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]):
    """A staged result shared by the queries of one session over one data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _memo:
        _memo[key] = build()
    return _memo[key]

"""Registered queries and the SQL they are checked against."""

from . import changes, code, graphs  # noqa: F401
from .base import ORACLES, QUERIES, compose


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return {name: compose(sql) for name, sql in ORACLES.items()}

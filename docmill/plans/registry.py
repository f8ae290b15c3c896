"""Registered queries: each takes the views; its SQL gives the same rows, or is None."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame

from docmill.plans.views import Views

#: Parameters that the queries run with.
PROJECT, USER, TERM, SINCE, UNTIL = 3, 7, "the", date(1998, 1, 1), date(1998, 6, 30)

QUERIES: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add

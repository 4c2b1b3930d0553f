"""The registry's table of queries and the helpers that all plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def by_track():
    return Window.partitionBy("track_id")


def by_beat():
    return by_track().orderBy("beat_idx")


def r6(c, name: str) -> Column:
    """A result column rounded to six places."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)

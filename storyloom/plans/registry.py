"""The list of queries and, where one exists, the equivalent SQL of each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom import model
from storyloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register a query; ``sql`` may name base tables as ``@t`` and relations plainly."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = re.sub(r"@(\w+)", r"\1", model.with_relations(sql, ctes))
        return fn

    return keep

"""A registry of queries, each with the SQL that must give the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


class Plans:
    def __init__(self) -> None:
        self._queries: dict[str, Build] = {}
        self._sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        def put(build: Build) -> Build:
            self._queries[name] = build
            if sql is not None:
                self._sql[name] = sql
            return build

        return put

    def queries(self) -> dict[str, Build]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)

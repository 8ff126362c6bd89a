"""Registered queries: every job bound to the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factledger.bindings import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, needs: str = "", sql: str | None = None):
    """Register a job ``fn(views) -> DataFrame`` and, when there is one, its SQL."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(needs, sql)
        return fn

    return wrap


def load_all() -> None:
    from factledger.queries import claims, corpus, files, findings, graphs, incremental, ingest, people, series  # noqa: F401

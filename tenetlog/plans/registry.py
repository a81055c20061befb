"""Queries by name: a Spark function over a table folder, and its SQL form if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenetlog.session import configure

LATE = "2024-04-01T00:00:00Z"   # a time that results state; large logs go on behind it
END = "9999-12-31T23:59:59Z"    # a cutoff after every log, of any size


class Registry:
    def __init__(self):
        self.functions: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(configure(spark), sf_dir)
            run.__name__, run.__doc__ = name, fn.__doc__
            self.functions[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn
        return wrap


registry = Registry()


def all_queries() -> Registry:
    from importlib import import_module
    for name in ("value_queries", "identity_queries", "commitment_queries", "report_queries"):
        import_module(f"tenetlog.plans.{name}")
    return registry

"""Registration of queries and the SQL texts that check them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriledge.plans.bindings import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None, recursive: bool = False):
    """Register ``fn(t: Tables) -> DataFrame`` and, where SQL can say it, its check."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(*tables, sql=sql, recursive=recursive)
        return fn

    return register

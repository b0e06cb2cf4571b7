"""Query registry: name -> (DataFrame builder, checking SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimcheck.plans.card_model import Cards, oracle_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register ``fn(cards) -> DataFrame``; ``needs`` lists model tables the SQL reads."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Cards(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle_sql(needs, sql)
        return fn

    return wrap

"""Name -> Spark query and, where SQL can say it, the SQL it must equal."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixture import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck(sql)
        return run

    return register

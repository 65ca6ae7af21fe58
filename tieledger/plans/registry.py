"""A list of queries: name, function of (spark, sf_dir), SQL or None."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieledger.plans.adapters import oracle, view


class Registry:
    def __init__(self) -> None:
        self.entries: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = []

    def add(self, name: str, sql: str | None = None):
        """Registers a function of ``v``, which gives a view or table by name."""

        def register(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                made: dict[str, DataFrame] = {}
                return make(lambda x: view(spark, sf_dir, x, made))

            self.entries.append((name, run, oracle(sql) if sql else None))
            return make

        return register


def us(name: str) -> Column:
    """A time as microseconds, which both engines give alike."""
    return F.unix_micros(name).alias(name)


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)

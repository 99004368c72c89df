"""Queries by name, the inventory ids they cover, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.views import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Views(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, with_views(sql) if sql else None)
        return build

    return register

"""Registered queries, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries by name; ``sql`` is left out where SQL cannot express one."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collect_all() -> Registry:
    from tidemark.queries import aggregations, filtering, joining, scalar, sources, windowing

    out = Registry()
    for module in (sources, filtering, joining, aggregations, windowing, scalar, *_later()):
        for name, f in module.R.queries.items():
            out.add(name, module.R.sql.get(name))(f)
    return out


def _later():
    from tidemark.queries import cohorts, evaluating, eventstreams, sequencing

    return eventstreams, cohorts, sequencing, evaluating

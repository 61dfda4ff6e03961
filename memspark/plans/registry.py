"""Named queries over the derived views, each with the SQL that gives the same rows on another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from memspark.plans.views import oracle_view, spark_view

View = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Callable[[View], DataFrame]
    views: tuple[str, ...]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(lambda name: spark_view(spark, sf_dir, name))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        recursive = body.upper().startswith("WITH RECURSIVE")
        if recursive:
            body = ", " + body[len("WITH RECURSIVE"):].strip()
        elif body.upper().startswith("WITH"):
            body = ", " + body[len("WITH"):].strip()
        ctes = ", ".join(f"{v} AS ({oracle_view(v)})" for v in self.views)
        if not self.views:
            return self.sql
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"


REGISTRY: dict[str, Query] = {}


def query(name: str, views: tuple[str, ...] | list[str] = (), sql: str | None = None):
    """Register a function of a view lookup; ``views`` are the derived views its SQL reads."""

    def add(run: Callable[[View], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, tuple(views), sql)
        return run

    return add

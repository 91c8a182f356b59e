"""Catalogue of runnable queries: name, Spark plan, and the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strataline.settings import ship

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")

        @wraps(plan)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plan(spark, sf_dir)

        CATALOG[name] = Query(name, run, sql)
        return plan

    return add

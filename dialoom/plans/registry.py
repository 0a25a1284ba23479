"""Registered queries: name -> (Spark callable, SQL check, inventory ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""

    def add(fn: Runner) -> Runner:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query registered twice: {fn.__name__}")
        REGISTRY[fn.__name__] = Query(fn.__name__, fn, sql, tuple(ids.split()))
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> dict[str, Query]:
    from dialoom.plans import (  # noqa: F401
        q_corpus,
        q_dates,
        q_inference,
        q_merges,
        q_relational,
        q_reports,
        q_schema,
        q_scripts,
        q_selection,
        q_sources,
        q_values,
    )

    return REGISTRY

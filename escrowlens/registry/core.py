"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from escrowlens.registry.oracle_tables import with_tables
from escrowlens.sources.marketplace import load_marketplace


@dataclass
class Query:
    name: str
    fn: Callable[..., DataFrame]
    sql: str | None
    needs_session: bool = False


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, needs_session: bool = False):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, with_tables(sql) if sql else None, needs_session)
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Output convention: decimals leave as double (rates, ratings) and nested
    values as JSON text, so both engines hash the same plain values."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load_marketplace(spark, sf_dir)
        if q.needs_session:
            return finish(q.fn(t, spark=spark, sf_dir=sf_dir))
        return finish(q.fn(t))
    run.__name__ = q.name
    run.__doc__ = q.fn.__doc__
    return run

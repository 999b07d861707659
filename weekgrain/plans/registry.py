"""Registry of named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.plans.tables import SQL, Tables


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    floats: list[str]


REGISTRY: dict[str, Query] = {}
PLACES = 6


def query(name: str, sql: str | None = None, floats: str = "", needs: str = "panel"):
    """Registers ``build(tables)``. ``sql`` may use the shared CTEs named in ``needs``."""

    def wrap(fn):
        text = None
        if sql is not None:
            ctes = SQL.ctes(needs.split())
            body = sql.strip()
            if body.upper().startswith("WITH "):
                body = body[5:]
                full = f"WITH {ctes + ', ' if ctes else ''}{body}"
            else:
                full = f"WITH {ctes} {body}" if ctes else body
            cols = floats.split()
            if cols:
                rounded = ", ".join(f"round({c} + 1e-9, {PLACES}) + 0.0 AS {c}" for c in cols)
                text = f"SELECT * REPLACE ({rounded}) FROM ({full}) AS q"
            else:
                text = full
        REGISTRY[name] = Query(name, fn, text, floats.split())
        return fn

    return wrap


def presented(df: DataFrame) -> DataFrame:
    """Doubles at a fixed number of decimals, so that summation order cannot show.

    The nudge takes exact halves the same way on both sides of the check.
    """
    kinds = dict(df.dtypes)
    return df.select([
        (F.round(F.col(c).cast("double") + F.lit(1e-9), PLACES) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
        for c in df.columns
    ])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(REGISTRY[name].build(Tables(spark, sf_dir)))

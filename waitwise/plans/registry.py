"""Registry of catalogue queries: name → (spark builder, DuckDB oracle text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SECTIONS: dict[str, str] = {}

DIGITS = 9


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double output column to ``digits`` (the oracle side does the same);
    adding 0.0 turns a rounded -0.0 into 0.0 so both engines print the same value."""
    cols = [(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def register(name: str, section: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        SECTIONS[name] = section
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return deco

"""Named queries with, where SQL can express them, an independent oracle for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as bigint, dates as text, so that two engines give equal rows."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out[name] = F.round(F.col(name), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            out[name] = F.col(name).cast("long")
        elif kind == "date":
            out[name] = F.col(name).cast("string")
    return df.withColumns(out) if out else df

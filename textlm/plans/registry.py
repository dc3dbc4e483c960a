"""Query registry shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

P_DIGITS = 12  # probabilities (values below 1)
PPL_DIGITS = 4  # ppl0 / ppl1 (values up to ~1e6)
PPL2_DIGITS = 6  # ppl2 (values in [1, 1.45])
X_DIGITS = 9  # other doubles of order 1


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"query {name!r} registered twice")
        REGISTRY[name] = fn
        return fn

    return deco


def r(c: str | Column, d: int, name: str | None = None) -> Column:
    """Round to ``d`` digits (same digits as the SQL twin) and alias."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, d).alias(name or (c if isinstance(c, str) else None))


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)

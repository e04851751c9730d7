"""Reusable relational building blocks (filters, pre-aggregated joins,
conditional aggregates, bag unions).

Everything here is DataFrame → DataFrame and stays inside Catalyst: filters
reach the parquet scan, aggregates run partial-then-final so a hot key is
combined map-side before it is shuffled.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status values that the reports exclude (fixed values of the source schema).
CLOSED_STATUSES = ("paid", "void", "written_off")
DEAD_STATUSES = ("void", "written_off")


def status_open(status: Column | str = "status") -> Column:
    """Not paid, void or written off. A NULL status is neither in nor out of
    the list, so the predicate is NULL and the row is dropped (SQL NOT IN)."""
    return ~_col(status).isin(*CLOSED_STATUSES)


def status_live(status: Column | str = "status") -> Column:
    """Not void or written off (paid stays). NULL status is dropped."""
    return ~_col(status).isin(*DEAD_STATUSES)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_when(cond: Column, value: Column, otherwise: Column | int = 0) -> Column:
    """``SUM(CASE WHEN cond THEN value ELSE otherwise END)``."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.sum(F.when(cond, value).otherwise(other))


def count_when(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def per_key_totals(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Aggregate ``df`` to one row per ``key`` (partial + final aggregation)."""
    return df.groupBy(key).agg(*[c.alias(name) for name, c in aggs.items()])


def left_join_preaggregated(left: DataFrame, right: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Left join ``left`` to a per-``key`` aggregate of ``right``.

    Aggregating first keeps the join one-to-one, so a key with many right rows
    cannot multiply the left rows; the aggregate is small and, when its
    runtime size allows, AQE broadcasts it.
    """
    return left.join(per_key_totals(right, key, **aggs), on=key, how="left")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (the grouping semantics of
    PARTITION BY / GROUP BY). Right-side key columns are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(r, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])

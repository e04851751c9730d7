"""Consecutive numbering in a total order without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task.
Here rows are range-partitioned on the order, numbered inside each
partition, and shifted by the sizes of the partitions before them; only one
row per partition (bounded by the partition count) is gathered.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .relational import null_safe_join


def number_rows(df: DataFrame, order: Sequence[str], start: int = 1, out: str = "seq",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = start, start+1, … following ``order`` (which must be a
    total order for a deterministic result)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Checkpoint the range-partitioned rows so the partition ids used for the
    # offsets and for the local numbers are the same physical partitions.
    ranged = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    )
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    return (
        local.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_off") + F.col("_local") + (start - 1)).cast("long"))
        .drop("_pid", "_local", "_off")
    )


def numbered_within(df: DataFrame, keys: Sequence[str], order: str, partitions: int | None = None) -> DataFrame:
    """Add ``_idx``, the position from 1 of each row within its key, in
    ``order`` (unique within a key; NULL last).

    The rows are range partitioned on (keys, order), which splits a hot key
    over partitions; local positions are shifted by the sizes of the key's
    partitions before, one row per (partition, key).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc() for k in keys], F.col(order).asc_nulls_last()]
    ranged = materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(F.col(order).asc_nulls_last())))
    sizes = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (null_safe_join(local, offsets, ["_pid", *keys])
            .withColumn("_idx", (F.col("_off") + F.col("_local")).cast("long")).drop("_pid", "_local", "_off"))

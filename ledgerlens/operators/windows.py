"""Window building blocks: trailing baselines over previous rows, lagged
percentage change, first row per key, and the split of long series.

A window partition holds one key's rows. The series fed to these operators
are per (key, period) aggregates, so a partition is bounded by the number of
periods (months), not by the raw data volume; the aggregation that builds
the series runs partial-then-final and absorbs hot keys.
"""

from __future__ import annotations

from math import ceil
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import null_safe_join


def ordered_window(keys: Sequence[str], order: str) -> WindowSpec:
    """Per-key window ordered by ``order`` (NULL order values last, as a
    pandas sort puts them)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(F.col(order).asc_nulls_last())


def trailing_stats(value: str, keys: Sequence[str], order: str, window: int, min_periods: int) -> dict[str, Column]:
    """Mean, sample std, least and largest value of the previous ``window`` rows
    (the current row excluded), mean and std NULL unless at least ``min_periods`` of them are non-NULL."""
    frame = ordered_window(keys, order).rowsBetween(-window, -1)
    enough = F.count(F.col(value)).over(frame) >= min_periods
    return {
        "mean": F.when(enough, F.avg(value).over(frame)),
        "std": F.when(enough, F.stddev_samp(value).over(frame)),
        "min": F.min(value).over(frame),
        "max": F.max(value).over(frame),
    }


def lagged_pct_change(value: str, keys: Sequence[str], order: str, periods: int) -> Column:
    """``value / value[periods rows earlier] − 1``; a zero or missing earlier
    value gives NULL."""
    prev = F.lag(value, periods).over(ordered_window(keys, order))
    return F.col(value) / F.nullif(prev, F.lit(0.0)) - 1


def forward_filled(value: str, keys: Sequence[str], order: str) -> Column:
    """Last non-NULL value up to the current row (pad fill)."""
    frame = ordered_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(frame)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order`` (Spark plans the ``= 1`` filter as a
    per-partition group limit before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


# --------------------------------------------------------------------------
# Split mode for long series (a hot key)
# --------------------------------------------------------------------------

# Keys long enough to be split are broadcast with their cuts up to this many.
CUT_KEYS = 100_000
# Blocks of the longest key for each shuffle partition, at most: more would
# spread its rows no further, and each row is placed among the cuts of its key.
BLOCKS_PER_PARTITION = 4


def _lead(df: DataFrame, order: str) -> Column:
    """A column that ``percentile_approx`` takes and that never falls while
    ``order`` rises: of a struct its first field, of a string its first bytes."""
    kind, c = df.schema[order].dataType, F.col(order)
    while isinstance(kind, T.StructType):
        c, kind = c[kind.fields[0].name], kind.fields[0].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return c


def _cuts_below(cuts: Column, lead: Column, ranges: int) -> Column:
    """How many of the sorted ``cuts`` (fewer than ``ranges``) are less than
    ``lead``, by halving."""
    steps = [1 << b for b in reversed(range((ranges - 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda at, step: F.when(F.get(cuts, at + step - 1) < lead, at + step).otherwise(at))


def with_blocks(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """Add ``_block``: of a key with more than ``block_rows`` rows, which of
    its ranges of ``order`` (cut at quantiles, about ``block_rows`` rows each,
    or more where that makes over ``BLOCKS_PER_PARTITION`` blocks per shuffle
    partition) a row lies in, from 0; of any other key NULL. NULL order values
    are in the last range, rows that share a leading value in the same one.

    The cuts come from quantile sketches per key, combined map-side; no row
    moves. Building the plan runs one grouped count.
    """
    lead = _lead(df, order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
    shape = sizes.agg(F.count(F.lit(1)).alias("long_keys"), F.max("_n").alias("most")).first()
    if not shape["long_keys"]:
        return df.withColumn("_block", F.lit(None).cast("int"))
    most = BLOCKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2, min(ceil(shape["most"] / block_rows), most))
    quantiles = F.percentile_approx(lead, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))
    cuts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), quantiles.alias("_cuts")).filter(F.col("_n") > block_rows).drop("_n")
    block = F.when(lead.isNull(), F.size("_cuts")).otherwise(_cuts_below(F.col("_cuts"), lead, ranges))
    if keys:
        cuts = F.broadcast(cuts) if shape["long_keys"] <= CUT_KEYS else cuts
        return null_safe_join(df, cuts, keys, "left").withColumn("_block", F.when(F.col("_cuts").isNotNull(), block)).drop("_cuts")
    listed = cuts.first()["_cuts"]  # one series: as many cuts as ranges
    return df.withColumn("_cuts", F.array(*[F.lit(c) for c in listed])).withColumn("_block", block).drop("_cuts")


def split_series(df: DataFrame, keys: Sequence[str], order: str, halo: int, block_rows: int) -> DataFrame:
    """Cut each long key's series into blocks of about ``block_rows`` or more
    consecutive rows (``with_blocks``), each preceded by a copy of the last
    ``halo`` rows before it.

    Adds ``_block`` and ``_halo`` (True on the copies). A rows frame reaching
    at most ``halo`` rows back, evaluated over ``partitionBy(*keys, "_block")
    .orderBy(order)`` and kept on ``~_halo`` rows, equals the same frame over
    the whole key, and a window partition holds one block.

    Only that window exchanges all rows. The copies come from the last ``halo``
    rows of each block, of which a scan task sends on no more than so many per
    block (a group limit before the exchange); where a block has fewer, the
    copies reach back over several. ``order`` must be unique within a key.
    """
    if block_rows < halo:
        raise ValueError("block_rows must be at least the halo")
    placed = with_blocks(df, keys, order, block_rows)
    own = placed.withColumn("_block", F.coalesce("_block", F.lit(0))).withColumn("_halo", F.lit(False))
    last = Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc_nulls_first())
    tails = (placed.filter(F.col("_block").isNotNull())
             .withColumn("_back", F.row_number().over(last)).filter(F.col("_back") <= halo).drop("_back"))
    # From here on a key has `halo` rows for each block at most.
    whole = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    tails = tails.withColumn("_place", F.row_number().over(whole))
    ends = tails.groupBy(*keys, "_block").agg(F.max("_place").alias("_upto"))
    ends = ends.withColumn("_next", F.lead("_block").over(Window.partitionBy(*keys).orderBy("_block"))).filter(F.col("_next").isNotNull())
    # The rows before block `next` are the places up to `upto`; a row is among the last `halo` of these for few blocks.
    wanted = ends.groupBy(*keys).agg(F.collect_list(F.struct("_upto", "_next")).alias("_ends"))
    near = F.filter("_ends", lambda e: (F.col("_place") <= e["_upto"]) & (F.col("_place") > e["_upto"] - halo))
    copies = (null_safe_join(tails, wanted, keys) if keys else tails.withColumn("_ends", wanted.scalar()))
    copies = (copies.withColumn("_block", F.explode(F.transform(near, lambda e: e["_next"])))
              .drop("_place", "_ends").withColumn("_halo", F.lit(True)))
    return own.unionByName(copies)


def forward_filled_split(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """Forward fill (last non-NULL value up to the row) on a split series:
    within the block (its halo included) by a running ``last``, and from
    earlier blocks through a per-block carry (one row per block)."""
    bkeys = [*keys, "_block"]
    inside = F.last(value, ignorenulls=True).over(
        ordered_window(bkeys, order).rowsBetween(Window.unboundedPreceding, 0))
    # The last value of a block is that of its greatest order, NULL order being the greatest.
    rank = F.struct(F.col(order).isNull(), F.col(order))
    blocks = df.filter(~F.col("_halo")).groupBy(*bkeys).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias("_last"))
    # carry into a block = last non-NULL of all blocks before (a window over one row per block)
    carried = blocks.select(
        *bkeys,
        F.last("_last", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
    )
    return (null_safe_join(df.withColumn("_in", inside), carried, bkeys, "left")
            .withColumn("_filled", F.coalesce(F.col("_in"), F.col("_carry"))).drop("_in", "_carry"))

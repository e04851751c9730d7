"""Left joins whose many side has hot keys.

A left outer join can be split by Spark only on its left side, so a key with a
third of all rows of the right side is one task. Here hot keys are measured
first, by a frequent-items sketch over the key alone (map-side, bounded, no
shuffle of keys), and only those are salted: their right rows are dealt over
salts by a hash of columns that tell them apart (not in turn: a task that runs
again must deal alike), their left rows copied to each. Every other key keeps salt 0. The
join stays one left join: each side is scanned once and exchanged once.
"""

from __future__ import annotations

from math import ceil
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on, and gets a salt for each so many.
HOT_ROWS = 1_000_000
# The sketch tracks this many keys and reports the most frequent ones: any key
# with more than some 4 / SKETCH_KEYS of all rows is among those tracked.
SKETCH_KEYS, REPORTED_KEYS = 16_384, 100


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> dict:
    """``{key: salts}`` of the keys with at least ``hot_rows`` rows, as far as
    a sketch tells (one pass over the key column; at most ``REPORTED_KEYS``).
    The counts only choose the number of salts, no result depends on them."""
    top = df.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {REPORTED_KEYS}, {SKETCH_KEYS})").alias("top")).first()["top"]
    return {r["item"]: ceil(r["count"] / hot_rows) + 1 for r in top or () if r["count"] >= hot_rows}


def _salts(key: Column, hot: dict) -> Column:
    listed = F.create_map(*[F.lit(x) for item in hot.items() for x in item])
    return F.coalesce(F.try_element_at(listed, key), F.lit(1))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, hot: dict, spread: Sequence[str]) -> DataFrame:
    """``left ⟕ right USING (key)``, with the keys of ``hot`` (as ``hot_keys``
    gives them, so each has rows on the right) spread over their salts by the
    right columns ``spread``, which aren't passed on."""
    if not hot:
        return left.join(right.drop(*spread), key, "left")
    salts = F.when(F.col(key).isNull(), 1).otherwise(_salts(F.col(key), hot))
    copied = left.withColumn("_salts", salts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    dealt = right.withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop(*spread).withColumn("_found", F.lit(True))
    joined = copied.join(dealt, [key, "_salt"], "left")
    # A hot key has matches, so a copy that met none at its salt isn't an unmatched row.
    return joined.filter(F.col("_found").isNotNull() | (F.col("_salts") == 1)).drop("_salt", "_salts", "_found")

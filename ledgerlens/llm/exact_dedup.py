"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by their most significant digits first: by length and leading
bytes, then by ever longer runs of successive bytes. A round groups what is
still together by the next bytes, counting map-side first, and joins the group
sizes back. A row is finished when its group is a singleton or its text has
ended; only the rest goes on. Groups are told apart by the bytes themselves,
so equality needs no digest. Digits widen sixteenfold a round, so the longest
text decides only the (logarithmic) number of rounds, and re-sending the bytes
already split by costs a sixteenth.

A group that holds a third of all rows reaches the count as one row per task.
Its size comes back to its rows by broadcast, as those of all groups above a
bound do; the bound grows with the rows, so that these groups take at most
``BROADCAST_BYTES``, and no task joins more rows of one group than the bound.
Rounds are checkpointed in the shared folder.

Defined results: NULL counts as the empty text. Rows with NULL ids are members
of their group but stay only where no member has an id. Repeated rows (same id
and text) are members each; ``exact_groups`` marks each row that has the
largest id, ``drop_exact_duplicates`` keeps one of them. Very long texts take
a logarithmic number of rounds. An empty table gives no rows. ``exact_groups``
reads the id and the text only; ``drop_exact_duplicates`` keeps all columns as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_winners, materialize, utf8

#: Bytes of the first digit, and how many times wider each next prefix is.
FIRST_BYTES, WIDEN = 32, 16
#: Groups of at least so many rows are joined by broadcast, as far as they take at most so many bytes.
LARGE_GROUP, BROADCAST_BYTES = 200, 8 << 20


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``keep_id`` (the largest id of its
    group of equal texts), ``group_size``, ``kept`` and ``text_sha256``."""
    active = df.select(F.col(doc_id).alias("id"), F.sha2(utf8(text), 256).alias("text_sha256"),
                       utf8(text).alias("body"))
    active = active.withColumn("n", F.length("body"))
    finished, upto = [], FIRST_BYTES
    while True:
        split = active.withColumn("digits", F.substring("body", 1, upto))
        sizes = split.groupBy("n", "digits").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
        done = (F.col("group_size") == 1) | (F.col("n") <= upto)
        # The bytes of finished rows aren't needed any more.
        round_ = materialize(_with_sizes(split, sizes, upto).select(
            "id", "text_sha256", "n", F.when(~done, F.col("body")).alias("body"), "group_size", "keep_id"))
        finished.append(round_.where("body IS NULL").select("id", "text_sha256", "group_size", "keep_id"))
        active = round_.where("body IS NOT NULL").select("id", "text_sha256", "n", "body")
        if active.isEmpty():
            break
        upto *= WIDEN
    out = finished[0]
    for part in finished[1:]:
        out = out.union(part)
    return out.select(F.col("id").alias(doc_id), "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_sizes(split: DataFrame, sizes: DataFrame, upto: int) -> DataFrame:
    """``split`` with its groups' ``group_size`` and ``keep_id``."""
    rows = split.agg(F.count(F.lit(1))).first()[0]
    least = max(LARGE_GROUP, rows * upto // BROADCAST_BYTES)  # so there are at most BROADCAST_BYTES / upto groups as large
    large = materialize(sizes.where(F.col("group_size") >= least))
    if large.isEmpty():
        return split.join(sizes, ["n", "digits"])
    key, member = ["n", "digits"], F.broadcast(large)
    return split.join(member, key).unionByName(split.join(member, key, "left_anti").join(sizes, key))


def drop_exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, the one with the largest id."""
    kept = exact_groups(df, doc_id, text).where("kept").select(doc_id, "text_sha256").distinct()
    return keep_winners(df, kept, doc_id, text)

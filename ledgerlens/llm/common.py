"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import materialize, scratch_folder

__all__ = ["append_columns", "fresh_name", "keep_winners", "let", "materialize", "once_per_worker", "read_table",
           "shared_folder", "text_or_empty", "utf8"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def utf8(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column, NULL as no bytes."""
    return text_or_empty(text).cast("binary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row however often, and
    in whatever lambda, ``body`` uses it (a lambda variable isn't inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores put before it until no column has that name.

    Spark resolves names without regard to case, so the comparison does too.
    """
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder; the
    folder is removed when the driver ends."""
    return scratch_folder(spark, kind)


def append_columns(df: DataFrame, source: str, fields: T.StructType, start: Callable[[], Callable],
                   block_bytes: int = 4 << 20, keep_source: bool = True) -> DataFrame:
    """Add ``fields``, computed in Python from column ``source``, to every row.

    Rows pass through Arrow without a shuffle. ``start()`` is called once per
    task; what it returns gets the source values of one block as an Arrow
    array and gives one Arrow array per field. A block holds about ``block_bytes`` of source data
    (one value at least), so a task's memory is bounded by a block and one
    Arrow batch. Columns of ``df`` named like a new field are replaced; without
    ``keep_source`` the source column isn't sent back from Python.
    """
    new = {f.name.lower() for f in fields}
    kept = df.select(*[c for c in df.columns if c.lower() not in new or c == source])
    if source.lower() in new:
        hidden = fresh_name(df, "_source")
        kept, source, keep_source = kept.withColumnRenamed(source, hidden), hidden, False
    at = kept.columns.index(source)
    sent = [i for i in range(len(kept.columns)) if keep_source or i != at]
    schema = T.StructType([*[kept.schema.fields[i] for i in sent], *fields.fields])
    names = schema.names

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compute = start()
        for batch in batches:
            for part in byte_blocks(batch, at, block_bytes):
                made = compute(part.column(at))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in sent], *made], names=names)

    return kept.mapInArrow(run, schema)


def byte_blocks(batch, at: int, block_bytes: int) -> Iterator:
    """Slices of an Arrow batch that hold about ``block_bytes`` of column ``at``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(at)
    if pa.types.is_list(column.type):
        sizes = pc.multiply(pc.list_value_length(column), 4)
    else:
        sizes = pc.binary_length(column)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + block_bytes, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


_WORKER_CACHE: dict = {}


def once_per_worker(key: str, make: Callable):
    """``make()``, called once in each Python worker and kept for its later tasks."""
    if key not in _WORKER_CACHE:
        _WORKER_CACHE.clear()  # one kept object at a time
        _WORKER_CACHE[key] = make()
    return _WORKER_CACHE[key]


def keep_winners(docs: DataFrame, winners: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``winners`` (id, SHA-256 of the text), one
    row for each: of repeated rows, which agree in both, one stays.

    Ids compare null-safe, so rows without an id are found too.
    """
    digest = fresh_name(docs, "_sha256")
    wid, wsha = fresh_name(docs, "_winner_id"), fresh_name(docs, "_winner_sha256")
    named = winners.toDF(wid, wsha)
    sided = docs.withColumn(digest, F.sha2(utf8(text_col), 256))
    same = (F.col(digest) == F.col(wsha)) & F.col(id_col).eqNullSafe(F.col(wid))
    return sided.join(named, same, "left_semi").dropDuplicates([digest, id_col]).drop(digest)

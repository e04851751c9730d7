"""Repeated passages by Rabin-Karp hashes of every window of words.

Every run of 50 words of every text is hashed by a rolling polynomial over the
words' hashes. Windows are dealt to buckets by their hash and counted there: a
window that also stands in a document with a smaller id is to go. The repeated
windows of a document are merged into maximal intervals of words, which are cut
out. Documents are judged as they came, not by what is left of others.

Before the shuffle, each block of documents is counted by itself: of a window
that several of its documents hold, only the least one's is sent on, the others
are decided. So a passage that a third of all documents hold reaches its bucket
once per block. What a block has for a bucket is one row: 10 bytes of hashes for
each occurrence, and ids and places, in order, as differences of varying length,
1 to 2 bytes each while a document has several windows in the bucket and about 5
together where it has one, however many buckets there are. Decided places go
back in rows of the same kind, by groups of documents. Blocks, buckets and groups
bound the memory of a task: a block holds ``BLOCK_BYTES`` of text (or one
document), a bucket the windows of the corpus over ``BUCKETS`` times
``spark.sql.shuffle.partitions``, a group the decided places over the latter.

Two windows with different words are taken for equal with a chance of 2^-80.

Defined results: words are what white space (space, tab to carriage return)
separates, unchanged; NULL and empty texts have none, texts of fewer words than a
window lose none. Ids are whole numbers; NULL ids count as the largest. Rows with
the same id never remove words of one another; repeated rows (same id and text)
each lose the same. Only where ids are repeated is the text's XXH64 sent with
them. Very long texts are one block each. An empty table gives no rows. Columns
of the input named like an output are replaced.
"""

from __future__ import annotations

from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_count

from .common import byte_blocks, fresh_name, materialize, text_or_empty, utf8

WINDOW = 50
#: Text of one block, and buckets for each shuffle partition.
BLOCK_BYTES, BUCKETS = 4 << 20, 4
#: Decided places that a task gathers into one row for each group.
PLACES = 1 << 20
#: Intervals are broadcast to the texts up to so many documents with so many intervals; beyond, texts are shuffled to them.
BROADCAST_DOCS, BROADCAST_INTERVALS = 500_000, 2_000_000
#: What a row without an id counts as.
NO_ID = (1 << 63) - 1
WHITE = r"[ \t-\r]+"

# The odd bases of the two polynomials, modulo 2^64.
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
# A row for each bucket (or group) that a block has occurrences for: runs of one document each, then places and hashes.
_SENT = "bucket int, ids binary, keys array<long>, per_doc binary, starts binary, hashes array<long>, checks array<short>"
_NAMES = ["bucket", "ids", "keys", "per_doc", "starts", "hashes", "checks"]


def words_of(text: str | Column) -> Column:
    """The words of a text: what white space separates."""
    return F.array_remove(F.split(text_or_empty(text), WHITE), "")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling_hashes(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial hash modulo 2^64 of every ``window`` successive values,
    as differences of running sums, divided by the power of their place."""
    n = len(values)
    if n < window:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(n, base, np.uint64))
    inverse = np.cumprod(np.full(n - window + 1, pow(base, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers)])
    return _mixed((sums[window:] - sums[:-window]) * inverse)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _varints(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers (not negative) as 7 bits a byte, the last byte without its high
    bit; one binary for each of the slices between ``bounds``."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        sizes += rest > 0
        rest >>= np.uint64(7)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(ends[-1], np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = sizes > k
        byte = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[:-1][some] + k] = byte.astype(np.uint8) | np.where(sizes[some] > k + 1, 128, 0).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds].astype(np.int32)), pa.py_buffer(out)])


def _numbers(binaries: pa.Array) -> np.ndarray:
    """The numbers of all ``_varints`` of a column, in a row."""
    raw = np.frombuffer(b"".join(binaries.to_pylist()), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    begins = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(raw)]])))
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, begins).view(np.int64)


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0] * (n > 0), np.flatnonzero(new) + 1, [n]]).astype(np.int64)


def _steps(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, begun anew at ``firsts`` (modulo 2^64, so of any ids)."""
    steps = np.diff(values.view(np.uint64), prepend=np.zeros(1, np.uint64))
    steps[firsts] = values.view(np.uint64)[firsts]
    return steps


def _summed(steps: np.ndarray, per_run: np.ndarray) -> np.ndarray:
    """The numbers that ``_steps`` came from, with so many in each run."""
    ends = np.cumsum(steps.view(np.uint64))
    before = np.cumsum(per_run) - per_run
    return (ends - np.repeat(ends[before] - steps.view(np.uint64)[before], per_run)).view(np.int64)


def _packed(bucket, ids, keys, start, hashes=None, checks=None) -> pa.RecordBatch:
    """Occurrences, sorted by bucket, id, key and start, as rows of ``_SENT``."""
    rows, runs = _bounds(bucket), _bounds(bucket, ids, keys)
    per_row = np.searchsorted(runs, rows)
    first = runs[:-1]
    none = np.zeros_like(rows)
    columns = [pa.array(bucket[rows[:-1]], pa.int32()), _varints(_steps(ids[first], per_row[:-1]), per_row),
               _lists(keys[first], per_row, pa.int64()), _varints(np.diff(runs), per_row), _varints(_steps(start, first), rows),
               _lists(np.zeros(0, np.int64), none, pa.int64()) if hashes is None else _lists(hashes.view(np.int64), rows, pa.int64()),
               _lists(np.zeros(0, np.int16), none, pa.int16()) if checks is None else _lists(checks, rows, pa.int16())]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Ids, keys and starts of the occurrences of whole rows."""
    per_doc = _numbers(batch.column(3))
    ids = _summed(_numbers(batch.column(1)), pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.repeat(ids, per_doc), np.repeat(_flat(batch.column(2)), per_doc), _summed(_numbers(batch.column(4)), per_doc)


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (_mixed(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _count_block(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block: what is decided in it, and what its buckets are to count."""
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    split = [texts[i].split() for i in order.tolist()]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    del split
    windows = np.maximum(sizes - window + 1, 0)
    if not windows.any():
        return
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(sizes) - sizes, windows) + start
    hashes = rolling_hashes(values, window, _BASES[0])[at]
    checks = (rolling_hashes(_mixed(values), window, _BASES[1])[at] >> np.uint64(48)).astype(np.uint16).view(np.int16)
    ids, keys = np.repeat(ids, windows), np.repeat(keys, windows)

    by_hash = np.argsort(hashes, kind="stable")  # of equal windows, the least id comes first
    groups = _bounds(hashes[by_hash], checks[by_hash])
    decided = np.zeros(len(ids), bool)
    decided[by_hash] = ids[by_hash] > np.repeat(ids[by_hash[groups[:-1]]], np.diff(groups))
    # Both go to the window's bucket: whatever the order of rows, and so the blocks, of a task that runs
    # again, what it has of one window comes from one run.
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    gone, left = by_bucket[decided[by_bucket]], by_bucket[~decided[by_bucket]]
    if len(gone):
        yield _packed(bucket[gone], ids[gone], keys[gone], start[gone])
    yield _packed(bucket[left], ids[left], keys[left], start[left], hashes[left], checks[left])


def _decide(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of one bucket, the decided places and those of windows that a smaller id
    has too, as ids, keys and starts."""
    counted = pa.compute.greater(pa.compute.list_value_length(batch.column(5)), 0)
    found = [_unpacked(batch.filter(pa.compute.invert(counted)))]
    batch = batch.filter(counted)
    hashes, checks = _flat(batch.column(5)), _flat(batch.column(6))
    order = np.argsort(hashes)
    same = np.concatenate([[False], hashes[order][1:] == hashes[order][:-1], [False]])[:len(order) + 1]
    order = order[same[1:] | same[:-1]] if len(order) else order
    if len(order):
        ids, keys, starts = (c[order] for c in _unpacked(batch))
        hashes, checks = hashes[order], checks[order]
        order = np.lexsort((ids, checks, hashes))
        same = _bounds(hashes[order], checks[order])
        repeated = order[ids[order] > np.repeat(ids[order[same[:-1]]], np.diff(same))]
        found.append((ids[repeated], keys[repeated], starts[repeated]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _grouped(found: list[tuple[np.ndarray, ...]], groups: int) -> Iterator[pa.RecordBatch]:
    """Decided places as a row for each group of documents."""
    ids, keys, starts = (np.concatenate(c) for c in zip(*found))
    group = _group(ids, groups)
    order = np.lexsort((starts, keys, ids, group))
    if len(order):
        yield _packed(group[order], ids[order], keys[order], starts[order])


def _merge(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """The intervals of the documents of one group."""
    ids, keys, starts = _unpacked(batch)
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order]
    far = np.concatenate([[True], starts[1:] > starts[:-1] + window])
    far[_bounds(ids, keys)[:-1]] = True
    begins = np.flatnonzero(far)
    lasts = np.concatenate([begins[1:], [len(starts)]]) - 1
    ids, keys = ids[begins], keys[begins]
    runs = _bounds(ids, keys)
    pairs = pa.StructArray.from_arrays([pa.array(starts[begins], pa.int32()), pa.array(starts[lasts] + window, pa.int32())], names=["first", "after"])
    return pa.RecordBatch.from_arrays([pa.array(ids[runs[:-1]]), pa.array(keys[runs[:-1]]), pa.ListArray.from_arrays(
        pa.array(runs, pa.int32()), pairs)], names=["id", "key", "intervals"])


def _each_bucket(batches: Iterator, work) -> Iterator:
    """``work`` on the rows of each bucket (column 0) in turn; rows come sorted by it."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = _bounds(bucket)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if kept and kept[0].column(0)[0].as_py() != bucket[a]:
                yield work(_one(kept))
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield work(_one(kept))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def removal_intervals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keyed: bool = True) -> DataFrame:
    """``(id, key, intervals)``: the maximal runs of words, as (first, after),
    that windows cover which also stand in a document with a smaller id; one row
    for each document with any. ``key`` is the XXH64 of its text, or 0 unless
    ``keyed``, for tables in which no id is repeated."""
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * groups

    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in byte_blocks(batch, 2, BLOCK_BYTES):
                ids, keys = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield from _count_block(ids, keys, part.column(2).to_pylist(), window, buckets)

    def decide(batches: Iterator) -> Iterator:
        found, size = [], 0
        for places in _each_bucket(batches, _decide):
            found.append(places)
            size += len(places[0])
            if size >= PLACES:
                yield from _grouped(found, groups)
                found, size = [], 0
        if found:
            yield from _grouped(found, groups)

    def merge(batches: Iterator) -> Iterator:
        return _each_bucket(batches, lambda rows: _merge(rows, window))

    narrow = df.select(_id(doc_id).alias("id"), _text_key(text, keyed).alias("key"), utf8(text).alias("body"))
    counted = narrow.mapInArrow(count, _SENT).repartition("bucket").sortWithinPartitions("bucket")
    decided = counted.mapInArrow(decide, _SENT).repartition("bucket").sortWithinPartitions("bucket")
    return decided.mapInArrow(merge, "id long, key long, intervals array<struct<first:int,after:int>>")


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def _text_key(text: str, keyed: bool) -> Column:
    return F.xxhash64(text_or_empty(text)) if keyed else F.lit(0).cast("long")


def drop_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with ``text`` freed of the words in its removal intervals (the
    rest joined by single spaces), ``n_words`` and ``n_removed``."""
    keyed = not df.groupBy(_id(doc_id)).count().where("count > 1").isEmpty()
    found = materialize(removal_intervals(df, doc_id, text, window, keyed))
    size = found.agg(F.sum(F.size("intervals").cast("long"))).first()[0] or 0
    if size <= BROADCAST_INTERVALS and bounded_count(found, BROADCAST_DOCS) <= BROADCAST_DOCS:
        found = F.broadcast(found)
    rest = df.drop(*[c for c in df.columns if c.lower() in ("n_words", "n_removed")])
    rid, key, cuts, words = (fresh_name(rest, c) for c in ("_rid", "_key", "_cuts", "_words"))
    here = (_id(doc_id) == F.col(rid)) & (_text_key(text, keyed) == F.col(key))
    joined = rest.join(found.toDF(rid, key, cuts), here, "left").withColumn(words, words_of(text))
    # What lies before each interval, and after the last.
    befores = F.transform(F.col(cuts), lambda c, i: F.slice(
        F.col(words), F.when(i == 0, 0).otherwise(F.get(F.col(cuts), i - 1)["after"]) + 1,
        c["first"] - F.when(i == 0, 0).otherwise(F.get(F.col(cuts), i - 1)["after"])))
    rest_from = F.element_at(F.col(cuts), -1)["after"]
    after = F.slice(F.col(words), rest_from + 1, F.size(words) - rest_from)
    kept = F.when(F.col(cuts).isNull(), F.col(words)).otherwise(F.concat(F.flatten(befores), after))
    removed = F.aggregate(F.col(cuts), F.lit(0), lambda n, c: n + c["after"] - c["first"])
    return (joined.withColumn("n_words", F.size(words).cast("long"))
            .withColumn("n_removed", F.coalesce(removed, F.lit(0)).cast("long"))
            .withColumn(text, F.array_join(kept, " ")).drop(rid, key, cuts, words))

"""Packing token ids into matrices by best-fit decreasing, and writing them.

Documents longer than a row are split, without loss, into segments of a row's
length and a rest. Segments are placed longest first, each into the open row
with the least room that still holds it; a segment tree over the capacities
finds that row in a logarithmic number of steps. A block of documents is packed
at a time, so a task's memory is bounded by ``BLOCK_TOKENS`` and one document,
and no rows move between tasks.

A block is written as one file of arrays, one after another (read them with
``numpy.load``): the id matrix, the rows' cumulative segment lengths and where
each row's begin, and a bit per position that is set where positions restart.
Files have names of their own in a folder all executors share; the manifest
lists the ones of the attempts that succeeded.

Defined results: a document without tokens (NULL or empty) is placed nowhere
and listed with 0 segments. Equal lengths are placed in their order of input.
Repeated rows are packed each. A very long document is split into as many rows as
it takes, in one block. An empty table writes nothing and gives no rows. Only the
id and the source column are read, so other columns' names don't clash.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, materialize

ROW_TOKENS, BLOCK_TOKENS = 2048, 4 << 20
SEGMENTS = "doc_id long, segment int, n_segments int, n_tokens int, row int, start int, ids_sha256 string, path string"


class CapacityTree:
    """How many open rows have each remaining capacity, as a segment tree."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def least_at_least(self, capacity: int) -> int | None:
        """The least capacity of an open row that is not below ``capacity``."""
        count, node = self.count, capacity + self.leaves
        if count[node]:
            return capacity
        while node > 1:  # up, to the first subtree on the right that has rows
            if node & 1 == 0 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:  # down, to its least capacity
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: np.ndarray, row_tokens: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and start of each segment, and the number of rows."""
    rows, starts = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_rows, n_rows = CapacityTree(row_tokens), {}, 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        room = tree.least_at_least(size)
        if room is None:
            row, room, n_rows = n_rows, row_tokens, n_rows + 1
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[i], starts[i] = row, row_tokens - room
        if room > size:
            open_rows.setdefault(room - size, []).append(row)
            tree.add(room - size, 1)
    return rows, starts, n_rows


def pack_block(ids: np.ndarray, doc_bounds: np.ndarray, row_tokens: int, pad: int) -> dict[str, np.ndarray]:
    """Pack one block: document d has ``ids[doc_bounds[d]:doc_bounds[d + 1]]``."""
    sizes = np.diff(doc_bounds)
    pieces = -(-sizes // row_tokens)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = doc_bounds[doc] + number * row_tokens
    length = np.minimum(row_tokens, doc_bounds[doc + 1] - first)
    row, start, n_rows = best_fit_decreasing(length, row_tokens)
    dtype = np.uint16 if not len(ids) or max(int(ids.max()), pad) < 1 << 16 else np.uint32
    matrix = np.full(n_rows * row_tokens, pad, dtype)
    offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    matrix[np.repeat(row * row_tokens + start, length) + offset] = ids[np.repeat(first, length) + offset]
    resets = np.zeros(n_rows * row_tokens, bool)
    resets[row * row_tokens + start] = True
    order = np.lexsort((start, row))
    per_row = np.bincount(row, minlength=n_rows) + 1
    begins = np.cumsum(per_row) - per_row
    cumulative = np.zeros(int(per_row.sum()), np.int32)  # 0, then the end of each segment
    place = np.arange(len(order)) + row[order] + 1
    cumulative[place] = (start + length)[order]
    return {"matrix": matrix.reshape(n_rows, row_tokens), "cumulative": cumulative, "row_begins": begins.astype(np.int64),
            "resets": np.packbits(resets.reshape(n_rows, row_tokens), axis=1), "doc": doc, "segment": number,
            "row": row, "start": start, "length": length, "pieces": pieces}


def pack(df: DataFrame, folder: str, tokens: Callable[[], Callable[[pa.Array], pa.ListArray]], doc_id: str = "doc_id",
         source: str = "text", row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, pad: int = 0) -> DataFrame:
    """Pack every row's tokens and write the matrices below ``folder``; returns
    where each segment lies (columns as ``SEGMENTS``), written already.

    ``tokens()``, called once per task, gives a function from an array of
    ``source`` values to their lists of ids; ``pack_ids`` takes ids as they are.
    """
    def run(batches: Iterator) -> Iterator:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode = tokens()
        docs, lists, held = [], [], 0
        for batch in batches:
            for part in byte_blocks(batch, 1, 4 << 20):
                found = encode(part.column(1))
                docs += part.column(0).to_pylist()
                lists.append(found)
                held += len(found.flatten())
                if held >= block_tokens:
                    yield _write(store, root, docs, lists, row_tokens, pad)
                    docs, lists, held = [], [], 0
        if docs:
            yield _write(store, root, docs, lists, row_tokens, pad)

    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"))
    return materialize(narrow.mapInArrow(run, SEGMENTS))


def pack_ids(df: DataFrame, folder: str, doc_id: str = "doc_id", ids: str = "ids", **how) -> DataFrame:
    """``pack`` of a column of id arrays; NULL ids are left out."""
    plain = df.withColumn(ids, F.filter(F.coalesce(F.col(ids), F.array().cast("array<int>")).cast("array<int>"), lambda x: x.isNotNull()))
    return pack(plain, folder, lambda: lambda lists: lists, doc_id, ids, **how)


def _write(store, root: str, docs: list, lists: list[pa.ListArray], row_tokens: int, pad: int) -> pa.RecordBatch:
    ids = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
    packed = pack_block(ids, np.concatenate([[0], np.cumsum(sizes)]), row_tokens, pad)
    path = f"{root}/{uuid.uuid4().hex}.npy"
    with store.open_output_stream(path, compression=None) as out:
        for name in ("matrix", "cumulative", "row_begins", "resets"):
            np.save(out, packed[name])
    rows, starts, lengths = packed["row"].tolist(), packed["start"].tolist(), packed["length"].tolist()
    flat = packed["matrix"].astype("<u4", copy=False)
    sha = [hashlib.sha256(flat[r, s:s + n].tobytes()).hexdigest() for r, s, n in zip(rows, starts, lengths)]
    of, pieces = packed["doc"].tolist(), packed["pieces"].tolist()
    none = [d for d, p in enumerate(pieces) if p == 0]
    blank = [None] * len(none)
    columns = [
        ("doc_id", pa.int64(), [docs[d] for d in of + none]), ("segment", pa.int32(), packed["segment"].tolist() + blank),
        ("n_segments", pa.int32(), [pieces[d] for d in of + none]), ("n_tokens", pa.int32(), lengths + [0] * len(none)),
        ("row", pa.int32(), rows + blank), ("start", pa.int32(), starts + blank), ("ids_sha256", pa.string(), sha + blank),
        ("path", pa.string(), [path] * len(of) + blank)]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in columns], names=[n for n, _, _ in columns])


def read_packed(folder: str, path: str) -> dict[str, np.ndarray]:
    """The arrays of one written file; ``resets`` as one value per position."""
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(path) as raw:
        found = {name: np.load(raw) for name in ("matrix", "cumulative", "row_begins", "resets")}
    found["resets"] = np.unpackbits(found["resets"], axis=1, count=found["matrix"].shape[1]).astype(bool)
    return found


def verify_packed(segments: DataFrame, folder: str) -> DataFrame:
    """``segments`` read back: the file's own ids hashed again, and whether the
    cumulative lengths and the resets agree, as ``verified``; ``file_sha256`` is
    that of the file's id matrix, the same whatever name the file was given.

    Files are of bounded size and read by one task each; their segments come
    together by path.
    """
    schema = segments.schema.add("verified", "boolean").add("file_sha256", "string")

    def check(pdf):
        path = pdf["path"].iloc[0]
        found = read_packed(folder, path)
        ok = []
        for row, start, n, sha in zip(pdf["row"], pdf["start"], pdf["n_tokens"], pdf["ids_sha256"]):
            begin = int(found["row_begins"][row])
            nxt = int(found["row_begins"][row + 1]) if row + 1 < len(found["row_begins"]) else len(found["cumulative"])
            ends = found["cumulative"][begin:nxt]
            at = int(np.searchsorted(ends, start))
            ids = found["matrix"][row, start:start + n].astype("<u4")
            ok.append(bool(ends[at] == start and ends[at + 1] == start + n and found["resets"][row, start]
                           and not found["resets"][row, start + 1:start + n].any()
                           and hashlib.sha256(ids.tobytes()).hexdigest() == sha))
        pdf["verified"], pdf["file_sha256"] = ok, hashlib.sha256(found["matrix"].astype("<u4").tobytes()).hexdigest()
        return pdf

    placed = segments.where("path IS NOT NULL").groupBy("path").applyInPandas(check, schema)
    return placed.unionByName(segments.where("path IS NULL").withColumn("verified", F.lit(True))
                            .withColumn("file_sha256", F.lit(None).cast("string")))

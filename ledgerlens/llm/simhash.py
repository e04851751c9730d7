"""SimHash near-duplicates by anchor-point covering.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Two fingerprints link at ``max_bits`` or fewer differing bits.

Anchors: the fingerprint's low and middle 31 bits form two bands. Of up to
three differing bits, one band holds at most one. The anchors of a band are the
2^26 words of the perfect Hamming code of length 31, whose covering radius is
one: every band value lies within one bit of exactly one anchor, its home. Each
fingerprint is copied to every anchor within the covering radius plus the
band's threshold, two bits: its home, and where it isn't an anchor itself the
15 anchors two bits away. Whoever differs from it by one bit in the band finds
it at their own home, so comparing, per anchor, the fingerprints at home there
with all that were copied there misses no link. All 64 bits are compared.

Equal fingerprints are merged before they are copied. A crowded anchor is split
into cells, a block of its homes against a block of its copies, so no task holds
more than ``HOME_BLOCK`` homes and ``COPY_BLOCK`` copies of it at once; a cell
emits only the links that join what was apart, so a dense group gives fewer
links than it has members. Components come from a distributed star algorithm.

Defined results: NULL and empty texts, and texts of white space, have
fingerprint zero and link like any other; texts of fewer words than a shingle
count as one shingle. Rows with NULL ids take part but never name a component
unless it has no other ids. Repeated rows each get their row. Very long texts
are hashed piece by piece, whole. An empty table gives no rows.
``near_duplicates`` reads the id and the text only; ``drop_near_duplicates``
keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, keep_winners, materialize, utf8
from .components import connected_components

SEED = 42
_BAND_BITS = 31
_BAND = (1 << _BAND_BITS) - 1
#: Home fingerprints and copies that one cell of a crowded anchor compares.
HOME_BLOCK, COPY_BLOCK = 4096, 1 << 16
_PER_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts, total = np.zeros(64, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for step in range(0, total, _PER_STEP):
        spans = zip(starts[step:step + _PER_STEP].tolist(), ends[step:step + _PER_STEP].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Add ``out``: the SimHash of ``text`` as a signed 64-bit number."""
    def start():
        def compute(texts: pa.Array) -> list:
            found = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
            return [pa.array(found.view(np.int64), pa.int64())]
        return compute

    return append_columns(df, text, T.StructType().add(out, T.LongType()), start)


def _syndrome(value: Column) -> Column:
    """The exclusive or of the numbers, from 1, of the bits set in a band."""
    checks = [sum(1 << (i - 1) for i in range(1, _BAND_BITS + 1) if i >> k & 1) for k in range(5)]
    bits = [F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(c))).bitwiseAND(F.lit(1)), k) for k, c in enumerate(checks)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3]).bitwiseOR(bits[4])


def anchor_copies(fps: DataFrame) -> DataFrame:
    """``(anchor, fp, home)``: each fingerprint at every anchor that covers it."""
    bands = [F.col("fp").bitwiseAND(F.lit(_BAND)),
             F.shiftrightunsigned("fp", _BAND_BITS).bitwiseAND(F.lit(_BAND))]
    banded = fps.select("fp", F.posexplode(F.array(*bands)).alias("band", "v"))
    banded = banded.withColumn("s", _syndrome(F.col("v")))
    copies = F.expr("""CASE WHEN s = 0 THEN array(named_struct('at', v, 'home', true)) ELSE
        concat(array(named_struct('at', v ^ shiftleft(1L, s - 1), 'home', true)),
               transform(filter(sequence(1, 31), i -> i < (i ^ s)),
                         i -> named_struct('at', v ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1), 'home', false)))
        END""")
    return (banded.select("fp", "band", F.explode(copies).alias("c"))
            .select((F.shiftleft(F.col("band").cast("long"), _BAND_BITS) + F.col("c.at")).alias("anchor"),
                    "fp", F.col("c.home").alias("home")))


def _compare(batches, max_bits: int):
    """Links of each (anchor, block) run in rows sorted by it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    kept = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if kept is not None:
            rows = [np.concatenate(pair) for pair in zip(kept, rows)]
        new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        cut = new[-1] if len(new) else 0  # the last run may go on in the next batch
        yield from _runs([c[:cut] for c in rows], new[:-1], max_bits, schema)
        kept = [c[cut:] for c in rows]
    if kept is not None:
        yield from _runs(kept, np.array([], np.int64), max_bits, schema)


def _runs(rows: list[np.ndarray], starts: np.ndarray, max_bits: int, schema: pa.Schema):
    fp, home = rows[2], rows[3].astype(bool)
    bounds = np.concatenate([[0], starts, [len(fp)]]).astype(np.int64)
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
        a, b = bounds[i], bounds[i + 1]
        links += _group_links(fp[a:b], np.flatnonzero(home[a:b]), max_bits)
    if links:
        ends = np.array(links, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)


def _group_links(fp: np.ndarray, homes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the members of one anchor within ``max_bits`` of a home."""
    label, links = np.arange(len(fp)), []
    for h in homes.tolist():
        near = np.flatnonzero(np.bitwise_count((fp ^ fp[h]).view(np.uint64)) <= max_bits)
        if len(near) == 1:
            continue
        groups, first = np.unique(label[near], return_index=True)
        if len(groups) > 1:  # one link to each part that h isn't in yet
            links += [(int(fp[h]), int(fp[n])) for g, n in zip(groups, near[first]) if g != label[h]]
            label[np.isin(label, groups)] = label[h]
    return links


def fingerprint_links(fps: DataFrame, max_bits: int = 3, home_block: int = HOME_BLOCK, copy_block: int = COPY_BLOCK) -> DataFrame:
    """``(a, b)`` links that connect all distinct fingerprints ``fp`` within
    ``max_bits`` (at most 3) of one another, as far as paths go."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two bands with a threshold of one bit each cover at most 3 differing bits")
    # Each fingerprint makes up to 32 copies, so few small partitions of them would be few long tasks. (By a
    # hash, as they come partitioned by themselves, which Spark would take for the same and coalesce.)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = anchor_copies(fps.repartition(parts, F.xxhash64("fp")))
    homes = F.sum(F.col("home").cast("int"))
    crowded = (copies.groupBy("anchor").agg(homes.alias("homes"), F.count(F.lit(1)).alias("n"))
               .where((F.col("homes") > home_block) | (F.col("n") > copy_block))
               .select("anchor", F.ceil(F.greatest("homes", F.lit(1)) / home_block).cast("int").alias("down"),
                       F.ceil(F.col("n") / copy_block).cast("int").alias("across")))
    down, across = F.coalesce("down", F.lit(1)), F.coalesce("across", F.lit(1))
    row = F.pmod(F.xxhash64("fp"), F.col("down")).cast("int")
    column = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("across")).cast("int")
    # As a copy it is in every cell of its column, as a home in every cell of its row.
    placed = (copies.join(crowded, "anchor", "left").withColumn("down", down).withColumn("across", across)
              .select("anchor", "fp", "home", row.alias("row"), column.alias("column"), "across",
                      F.explode(F.sequence(F.lit(0), F.col("down") * F.col("across") - 1)).alias("block"))
              .withColumn("home", F.col("home") & (F.floor(F.col("block") / F.col("across")) == F.col("row")))
              .where(F.col("home") | (F.col("block") % F.col("across") == F.col("column")))
              .select("anchor", "block", "fp", "home"))
    return (placed.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
            .mapInArrow(lambda batches: _compare(batches, max_bits), "a long, b long"))


def _components(df: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int) -> DataFrame:
    """``(id, text_sha256, fp, label, component_id)`` of every row."""
    narrow = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"),
                       F.sha2(utf8(text), 256).alias("text_sha256"))
    docs = materialize(with_fingerprints(narrow, "text", "fp", shingle).drop("text"))
    by_fp = docs.groupBy("fp").agg(F.min("id").alias("least"))
    labels = connected_components(fingerprint_links(by_fp.select("fp"), max_bits)).select(
        F.col("node").alias("fp"), "label")
    classed = by_fp.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = classed.join(classed.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    return docs.join(named.select("fp", "label", "component_id"), "fp")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """Every row's id, the SHA-256 of its text, its ``fingerprint`` (16 hex
    digits) and ``component_id``, the least id among all rows reachable over
    links. Other columns are left out; columns: ``doc_id``'s name,
    ``text_sha256``, ``fingerprint``, ``component_id``."""
    return _components(df, doc_id, text, shingle, max_bits).select(
        F.col("id").alias(doc_id), "text_sha256",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                         max_bits: int = 3) -> DataFrame:
    """One row of each component: the one with the least id (of ties, the one
    with the least SHA-256 of its text; a row without id only where the whole
    component has none)."""
    # Grouped by the component's own label: ids may be NULL or repeated.
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_sha256").alias("sha"))
    winners = _components(df, doc_id, text, shingle, max_bits).groupBy("label").agg(F.min(rank).alias("w"))
    return keep_winners(df, winners.select("w.id", "w.sha"), doc_id, text)

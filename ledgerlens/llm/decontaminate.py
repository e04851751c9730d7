"""Benchmark decontamination by item-sized windows, native functions only.

Texts become lower-case runs of letters and digits. A benchmark item of n words
is compared with windows of n words by their five-word shingles (an item of
fewer words is one shingle).

1. Windows of n words go on if so many of their places hold a shingle of items
   of n words (of any of them, in whatever order) as the similarity takes: of a
   window with v shingles and an item with m, at least s * (v + m) / (1 + s) must
   be shared for a similarity of s. Which item it may be is not known yet. (The
   benchmark's shingles are broadcast only where a bounded count proves them few.)
2. Each such window, and each item, gets a 64-bit SimHash. A multi-index finds all
   items of n words within ``RADIUS`` differing bits: the 64 bits are cut into
   ``RADIUS`` + 1 blocks, of which one must be equal, and windows are joined to
   items on (n, block, its bits).
3. Each pair found is compared exactly: weighted Jaccard similarity, a shingle's
   weight being the number of times it occurs.

The bits of a SimHash are independent of one another, so a pair at similarity
0.8, of which a bit differs with a chance of about 0.15, is within 20 bits but
for one in some thousands; most pairs are more alike. That needs many shingles to
vote. An item whose votes are few, because it is short or says a few things over
and over (fewer than ``VOTES`` shingles in effect: the square of their number
over the sum of squared weights), has no safe radius: such items are sought by
name in step 1 and go straight to step 3, so none is lost.

Defined results: NULL and empty texts and items hold nothing. Repeated documents
are found each; items with equal texts are found each. Of windows that are
equally alike the first is given. Rows are told apart by id (null-safe) and the
MD5 of their text. Very long texts are cut into windows piece by piece. Only the
id and the text are read by ``find_leaks``; ``drop_leaks`` keeps all columns as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_count, broadcast_if_bounded

from .common import fresh_name, let, materialize, text_or_empty

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits up to which the index finds items, and the least number of shingles, in effect, that vote on them.
RADIUS, VOTES = 20, 12
#: Benchmarks of at most so many shingles are broadcast to the documents' scan.
BROADCAST_SHINGLES = 500_000
#: So are at most so many (document, item) pairs that share a shingle, or documents that leak.
BROADCAST_HITS = 500_000
#: And only if they have at most so many windows between them (4 bytes each).
BROADCAST_STARTS = 2_000_000
#: Windows are cut out of a text in pieces of so many starts, which can be spread.
PIECE = 1_024


def words_of(text: Column) -> Column:
    """The words of a text: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _spans(words: str, width: str, last: str) -> str:
    """SQL for the array of positions (from 1) of the shingles of ``words``."""
    return f"CASE WHEN size({words}) >= {width} THEN sequence(1, {last}) ELSE array() END"


def _shingle_hashes(words: str, width: int) -> Column:
    """The hash of each shingle of ``width`` words, in order."""
    parts = ", ".join(f"get({words}, i - 1 + {k})" for k in range(width))
    return F.expr(f"transform({_spans(words, str(width), f'size({words}) - {width} + 1')}, i -> xxhash64({parts}))")


def _shingles(words: str, width: str) -> Column:
    """The shingles of ``words`` as strings; ``width`` names a column."""
    spans = _spans(words, width, f"size({words}) - {width} + 1")
    return F.expr(f"transform({spans}, i -> array_join(slice({words}, i, {width}), ' '))")


def simhash(shingles: Column) -> Column:
    """The 64-bit SimHash of an array of shingles. The counts of 64 bits are
    kept in 32 sums of two 32-bit lanes, which no array can overflow."""
    lane = F.lit(0x0000000100000001)
    zero = F.array_repeat(F.lit(0).cast("long"), 32)
    counts = F.aggregate(shingles, zero, lambda sums, s: let(F.xxhash64(s), lambda h: F.transform(
        sums, lambda x, k: x + F.call_function("shiftrightunsigned", h, k).bitwiseAND(lane))))

    def majority(of: Column) -> Column:
        bit = lambda b: F.call_function("shiftrightunsigned", F.get(of["sums"], b % 32), (F.floor(b / 32) * 32).cast("int")).bitwiseAND(
            F.lit(0xFFFFFFFF)) * 2 > of["n"]
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, b: f.bitwiseOR(
            F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))

    return let(F.struct(counts.alias("sums"), F.size(shingles).alias("n")), majority)


#: Sum of the squared counts of an array's shingles, over the sorted array: 1 + 3 + 5 ... for equal ones.
_SQUARES = """aggregate(array_sort(item_shingles), named_struct('last', '', 'k', 0L, 'sum', 0L), (a, s) -> named_struct(
    'last', s, 'k', CASE WHEN s = a.last THEN a.k + 1 ELSE 0L END, 'sum', a.sum + CASE WHEN s = a.last THEN 2 * a.k + 3 ELSE 1L END), a -> a.sum)"""


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, item_words, n, width, item_shingles, item_fp, named)`` of the
    items that have words; ``named`` are those with too few votes for the index."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("item_words"))
    items = items.withColumn("n", F.size("item_words")).where("n > 0").withColumn("width", F.least(F.lit(SHINGLE), F.col("n")))
    items = items.withColumn("item_shingles", _shingles("item_words", "width")).withColumn("item_fp", simhash(F.col("item_shingles")))
    size = F.size("item_shingles").cast("double")
    return items.withColumn("named", size * size < VOTES * F.expr(_SQUARES))


def _blocks(fp: str, radius: int) -> Column:
    """``(block, value)`` of each of ``radius`` + 1 blocks of a fingerprint."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"),
                              F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def _keys(named: str, item: str, fp: str) -> Column:
    """Where the index has an item: at each block of its fingerprint, or by its name."""
    of_name = F.array(F.struct(F.lit(-1).alias("block"), F.xxhash64(item).alias("value")))
    return F.when(F.col(named), of_name).otherwise(_blocks(fp, RADIUS))


def _starts(similarity: float) -> Column:
    """The starts of all windows that hold enough of the sorted places ``at``,
    in one pass over them: for each place, the starts after the place before it
    up to itself, as far as the places from it on suffice. A window that the end
    of the text cuts off has fewer shingles and holds all the places from its start on."""
    m, few = f"(n - least(n, {SHINGLE}) + 1)", 1e-9  # `few` for the rounding of doubles
    need = f"greatest(1, CAST(ceil({2 * similarity / (1 + similarity)}D * {m} - {few}D) AS INT))"
    after = "CASE WHEN i = 0 THEN 0 ELSE get(at, i - 1) + 1 END"
    ends = f"size - least(n, {SHINGLE}) + 1 + {m} - (size(at) - i) * {(1 + similarity) / max(similarity, few)}D - {few}D"
    whole = (f"greatest({after}, get(at, i + {need} - 1) - {m} + 1)", "least(get(at, i), size - n)")
    cut = (f"CAST(greatest({after}, size - n + 1, ceil({ends})) AS INT)", "get(at, i)")
    runs = [f"CASE WHEN {have} AND {low} <= {high} THEN sequence({low}, {high}) ELSE array() END"
            for have, (low, high) in ((f"i + {need} <= size(at)", whole), ("true", cut))]
    return F.expr(f"flatten(transform(sequence(0, size(at) - 1), i -> concat({', '.join(runs)})))")


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, text_md5, item_id, similarity, window_start, differing_bits)``:
    the best window of each document for each item it holds."""
    items = materialize(benchmark_items(benchmark, item_id, item_text))
    rows = docs.select(F.col(doc_id).alias("id"), F.md5(text_or_empty(text).cast("binary")).alias("text_md5"),
                       words_of(F.col(text)).alias("words"))

    # 1. Windows with so many places of the shingles of items of their size (or of one named item) as the similarity takes.
    hits = None
    for width in sorted(r["width"] for r in items.select("width").distinct().collect()):  # at most SHINGLE widths
        seeds = items.where(F.col("width") == width).select(
            "n", "named", F.when(F.col("named"), F.col("item_id")).alias("item"),
            F.explode(F.array_distinct(_shingle_hashes("item_words", width))).alias("h")).distinct()
        if bounded_count(seeds, BROADCAST_SHINGLES) <= BROADCAST_SHINGLES:
            seeds = F.broadcast(seeds)
        found = rows.select("id", "text_md5", F.size("words").alias("size"),
                            F.posexplode(_shingle_hashes("words", width)).alias("p", "h")).join(seeds, "h").select(
            "id", "text_md5", "size", "named", "item", "n", "p")
        hits = found if hits is None else hits.union(found)
    if hits is None:  # no item has a word
        return rows.select(F.col("id").alias(doc_id), "text_md5", F.lit(None).cast("long").alias("item_id"),
                           F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("window_start"),
                           F.lit(None).cast("int").alias("differing_bits")).where("false")
    places = hits.groupBy("id", "text_md5", "named", "item", "n", "size").agg(F.array_sort(F.collect_set("p")).alias("at"))
    starts = places.select("id", "text_md5", "named", "item", "n", _starts(similarity).alias("starts"))
    starts = materialize(starts.where(F.size("starts") > 0))

    # 2. The items within the radius of each window's SimHash, by equal blocks.
    here = starts.select(F.col("id").alias("wid"), F.col("text_md5").alias("wmd5"), "named", "item", "n", "starts")
    few = (here.agg(F.sum(F.size("starts").cast("long"))).first()[0] or 0) <= BROADCAST_STARTS
    if few:
        here = broadcast_if_bounded(here, BROADCAST_HITS)  # the documents' texts stay where they are; beyond, they are shuffled
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.md5(text_or_empty(text).cast("binary")).alias("text_md5"))
    pieces = (texts.join(here, F.col("id").eqNullSafe(F.col("wid")) & (F.col("text_md5") == F.col("wmd5")))
              .select("id", "text_md5", "named", "item", "n", F.array_sort("starts").alias("starts"), words_of(F.col("text")).alias("words"))
              .withColumn("piece", F.explode(F.expr(f"""transform(sequence(0, size(starts) - 1, {PIECE}), i -> struct(
                  slice(starts, i + 1, {PIECE}) AS starts, get(starts, i) AS first,
                  slice(words, get(starts, i) + 1, get(starts, least(i + {PIECE}, size(starts)) - 1) - get(starts, i) + n) AS words))""")))
              .select("id", "text_md5", "named", "item", "n", "piece.*"))
    if not few:  # a long text's windows are no longer one task's work
        pieces = pieces.repartition("id", "text_md5", "n", "first")
    windows = (pieces.withColumn("start", F.explode("starts"))
               .withColumn("width", F.least(F.lit(SHINGLE), F.col("n")))
               .withColumn("window", F.expr("slice(words, start - first + 1, n)"))
               .select("id", "text_md5", "named", "item", "n", "start", "width", "window")
               .withColumn("shingles", _shingles("window", "width")).where(F.size("shingles") > 0)
               .withColumn("fp", F.when(~F.col("named"), simhash(F.col("shingles")))))
    asked = windows.select("id", "text_md5", "item", "n", "start", "shingles", "fp", F.explode(_keys("named", "item", "fp")).alias("key"))
    index = items.select("item_id", "item_fp", F.col("n").alias("item_n"), F.explode(_keys("named", "item_id", "item_fp")).alias("item_key"))
    index = broadcast_if_bounded(index, BROADCAST_SHINGLES)
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # A pair stays at the first block that is equal: no block before it is.
    equal = F.zip_with(_blocks("fp", RADIUS), _blocks("item_fp", RADIUS), lambda a, b: a["value"] == b["value"])
    near = (bits <= RADIUS) & (F.array_position(equal, True) - 1 == F.col("key.block"))
    pairs = (asked.join(index, (F.col("n") == F.col("item_n")) & (F.col("key") == F.col("item_key")))
             .where(F.when(F.col("key.block") < 0, F.col("item").eqNullSafe(F.col("item_id"))).otherwise(near))
             .select("id", "text_md5", "start", "shingles", "item_id", "item_fp", "n"))
    whole = items.select(F.col("item_id").alias("its_id"), F.col("item_fp").alias("its_fp"), F.col("n").alias("its_n"), "item_shingles")
    pairs = pairs.join(broadcast_if_bounded(whole, BROADCAST_HITS), F.col("item_id").eqNullSafe(F.col("its_id"))
                       & (F.col("item_fp") == F.col("its_fp")) & (F.col("n") == F.col("its_n")))

    # 3. Exact weighted similarity: shared weight over the weight of either.
    shared = F.expr("""CASE WHEN size(array_distinct(shingles)) = size(shingles) OR size(array_distinct(item_shingles)) = size(item_shingles)
        THEN size(array_intersect(shingles, item_shingles))
        ELSE aggregate(array_intersect(shingles, item_shingles), 0, (sum, s) -> sum
            + least(size(filter(shingles, x -> x = s)), size(filter(item_shingles, x -> x = s)))) END""")
    alike = pairs.withColumn("shared", shared).withColumn(
        "similarity", F.col("shared") / (F.size("shingles") + F.size("item_shingles") - F.col("shared")))
    alike = alike.where(F.col("similarity") >= similarity).withColumn("fp", simhash(F.col("shingles")))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("before"), (-bits).alias("bits"))
    return (alike.groupBy("id", "text_md5", "item_id").agg(F.max(best).alias("w"))
            .select(F.col("id").alias(doc_id), "text_md5", "item_id", "w.similarity",
                    (-F.col("w.before")).alias("window_start"), (-F.col("w.bits")).alias("differing_bits")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    md5, lid, lmd5 = (fresh_name(docs, n) for n in ("_md5", "_leak_id", "_leak_md5"))
    leaks = find_leaks(docs, benchmark, doc_id, text, **how).select(F.col(doc_id).alias(lid), F.col("text_md5").alias(lmd5)).distinct()
    leaks = broadcast_if_bounded(materialize(leaks), BROADCAST_HITS)
    sided = docs.withColumn(md5, F.md5(text_or_empty(text).cast("binary")))
    return sided.join(leaks, F.col(doc_id).eqNullSafe(F.col(lid)) & (F.col(md5) == F.col(lmd5)), "left_anti").drop(md5)

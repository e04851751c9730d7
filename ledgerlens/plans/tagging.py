"""Ordered pattern tagging of text columns, appending new names to a pattern
list, and category statistics.

A text matches a pattern when the lowercased pattern occurs in the
lowercased text; among matching patterns the lowest ordinal wins. A text
with no match is ``(blocked = false, pattern = "")``.

A short list becomes one CASE expression over the text. A longer one stays a
DataFrame: it is indexed by one rare character gram of each pattern, joined to
the grams of the words of the texts (of whole texts for patterns with white
space), and only what is found there is searched for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import union_all
from ..operators.sequence import number_rows
from ..sources.patterns import DEFAULT_CATEGORY, DEFAULT_COMPANY, MISSING_CATEGORY

# Lists up to this size, proven by a count, become one CASE expression (no
# join, no shuffle, evaluated inside whole-stage codegen with early exit in
# list order); longer ones are indexed by grams. The answer is the same.
CASE_CHAIN_LIMIT = 512
# Characters of a gram; a shorter pattern is its own gram.
GRAM = 4
# What parts words; a pattern without it lies within one word.
SPACE = r"\s+"
# A longer word's grams are taken in one pass of a regular expression.
LONG_WORD = 64
# The gram index (one row for each pattern) is broadcast to the texts' grams
# up to this many patterns; beyond it the grams are shuffled.
INDEX_BROADCAST_LIMIT = 100_000


def _first_match_ordinal(text: Column, patterns: list[tuple[int, str]]) -> Column:
    """CASE over the list; names come folded by Spark's own ``lower``."""
    low = F.lower(text)
    expr = None
    for ordinal, name in patterns:
        cond = F.contains(low, F.lit(name))
        expr = F.when(cond, F.lit(ordinal)) if expr is None else expr.when(cond, F.lit(ordinal))
    return expr if expr is not None else F.lit(None).cast("int")


def _grams(text: Column, width: int) -> Column:
    """Every substring of ``width`` characters, in one pass over the text (a
    lookahead, so that they overlap)."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def _listed(patterns: DataFrame) -> DataFrame:
    """The list with folded names; a NULL name matches nothing."""
    return patterns.filter(F.col("name").isNotNull()).select(
        "ordinal", "name", F.coalesce("category", F.lit(MISSING_CATEGORY)).alias("category"), F.lower("name").alias("folded"))


def gram_index(patterns: DataFrame) -> DataFrame:
    """``(gram, entry)``, one row for each pattern that isn't empty: of its
    grams the one that the fewest patterns of the list share (ties by gram),
    with ``entry`` = (ordinal, folded, name, category)."""
    listed = _listed(patterns).filter(F.col("folded") != "")
    entry = F.struct("ordinal", "folded", "name", "category").alias("entry")
    # A pattern shorter than a gram is one itself.
    grams = F.when(F.length("folded") < GRAM, F.array("folded")).otherwise(_grams(F.col("folded"), GRAM))
    of = listed.select(entry, F.explode(F.array_distinct(grams)).alias("gram"))
    shared = of.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return (of.join(shared, "gram").groupBy("entry").agg(F.min(F.struct("n", "gram")).alias("rarest"))
            .select("rarest.gram", "entry"))


def _with_word_grams(words: DataFrame, widths: list[int]) -> DataFrame:
    """Adds ``gram``, a row for each substring of ``widths`` characters of
    ``word`` (and its shorter ends): cut at each place, in a long word, where
    that would be quadratic, by the single pass of ``_grams``."""
    word, at = F.col("word"), F.col("_at")
    places = F.sequence(F.lit(1), F.greatest(F.length(word) - (min(widths) - 1), F.lit(1)))
    cut = F.array(*[F.substring(word, at, F.lit(w)) for w in widths])
    return (words.withColumn("_at", F.explode(F.when(F.length(word) <= LONG_WORD, places).otherwise(F.array(F.lit(0)))))
            .withColumn("gram", F.explode(F.when(at > 0, cut).otherwise(F.concat(*[_grams(word, w) for w in widths])))).drop("_at"))


def _found_in_words(keyed: DataFrame, index: DataFrame, widths: list[int]) -> DataFrame:
    """``(_id, _key, _ord)`` of the patterns without white space: each lies in a
    word. Every distinct word of all texts is searched once, where one of its
    grams leads to a pattern, and the words of a text are joined to what was
    found in them."""
    words = F.split(F.lower("_text"), SPACE)
    hits = (_with_word_grams(keyed.select(F.explode(words).alias("word")).distinct(), widths).join(index, "gram")
            .filter(F.contains(F.col("word"), F.col("entry.folded"))).groupBy("word").agg(F.min("entry.ordinal").alias("_ord")))
    return keyed.select("_id", "_key", F.explode(F.array_distinct(words)).alias("word")).join(hits, "word").select("_id", "_key", "_ord")


def _found_across_words(keyed: DataFrame, index: DataFrame, widths: list[int]) -> DataFrame:
    """``(_id, _key, _ord)`` of the patterns with white space, in two passes over
    the texts: the first keeps, per text that shares a gram with any, the
    patterns to look for (only id, key and gram leave the scan); the second
    looks for them."""
    low = F.lower("_text")
    grams = F.array_distinct(F.concat(*[_grams(low, w) for w in widths]))
    near = (keyed.select(F.col("_id").alias("_of"), F.col("_key").alias("_own"), F.explode(grams).alias("gram"))
            .join(index, "gram").groupBy("_of", "_own").agg(F.collect_set(F.struct("entry.ordinal", "entry.folded")).alias("_near")))
    joined = keyed.join(near, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_own")))
    hits = F.transform(F.array(low), lambda t: F.filter("_near", lambda e: F.contains(t, e["folded"])))
    return joined.select("_id", "_key", F.explode(F.get(hits, F.lit(0))).alias("hit")).select("_id", "_key", F.col("hit.ordinal").alias("_ord"))


def _indexed_match(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, widths: dict[bool, list[int]],
                   broadcast_index: bool) -> DataFrame:
    """``(id_col, _text, _hit)``: the entry of the least ordinal found in each
    text; ``_text`` is NULL where the text is.

    ``widths`` has the gram widths of the patterns with (True) and without
    (False) white space. A text is known by its id and MD5 where its words or
    grams are joined; only the search across words shuffles texts.
    """
    index = gram_index(patterns).withColumn("_spaced", F.col("entry.folded").rlike(SPACE))
    key = F.unhex(F.md5(F.col(text_col).cast("binary")))
    keyed = texts.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(text_col).alias("_text"))
    found = []
    for spaced, search in ((False, _found_in_words), (True, _found_across_words)):
        if widths[spaced]:
            part = index.filter(F.col("_spaced") == spaced).drop("_spaced")
            found.append(search(keyed, F.broadcast(part) if broadcast_index else part, widths[spaced]))
    own = texts.select(F.col(id_col), key.alias("_text"))
    if not found:  # only an empty pattern
        return own.withColumn("_hit", F.lit(None).cast("struct<ordinal:bigint,name:string,category:string>"))
    first = union_all(found).groupBy("_id", "_key").agg(F.min("_ord").alias("_ord"))
    entries = _listed(patterns).select(F.col("ordinal").alias("_ord"), F.struct("ordinal", "name", "category").alias("_hit"))
    hit = first.join(F.broadcast(entries) if broadcast_index else entries, "_ord").drop("_ord")
    joined = own.join(hit, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    return joined.select(id_col, "_text", "_hit")


def tag_patterns(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text",
                 case_chain_limit: int = CASE_CHAIN_LIMIT) -> DataFrame:
    """(id, blocked, pattern, category) for every input row.

    Up to ``case_chain_limit`` entries the texts are read once by JVM
    expressions with no shuffle; the entries are in the plan. Beyond, the list
    stays distributed (``gram_index``). Building the plan runs one aggregate
    over the list. Repeated ordinals raise ValueError: order would be undefined.
    """
    width = F.least(F.length("folded"), F.lit(GRAM))
    spaced = F.col("folded").rlike(SPACE)
    empty = F.min(F.when(F.col("folded") == "", F.struct("ordinal", "name", "category")))
    shape = _listed(patterns).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("ordinals"),
                                  F.collect_set(F.when((width > 0) & ~spaced, width)).alias("widths"),
                                  F.collect_set(F.when(spaced, width)).alias("spaced_widths"), empty.alias("empty")).first()
    if shape["ordinals"] < shape["n"]:
        raise ValueError("the pattern list repeats an ordinal")
    if shape["n"] <= case_chain_limit:
        entries = _listed(patterns).orderBy("ordinal").collect()  # at most case_chain_limit
        match = _first_match_ordinal(F.col(text_col), [(r["ordinal"], r["folded"]) for r in entries])
        info = F.broadcast(_listed(patterns).select(F.col("ordinal").alias("_ord"), "name", "category"))
        hit = F.when(F.col("_ord").isNotNull(), F.struct("name", "category")).alias("_hit")
        tagged = texts.select(id_col, match.alias("_ord")).join(info, "_ord", "left").select(id_col, hit)
    else:
        widths = {False: sorted(shape["widths"]), True: sorted(shape["spaced_widths"])}
        tagged = _indexed_match(texts, patterns, id_col, text_col, widths, shape["n"] <= INDEX_BROADCAST_LIMIT)
        if shape["empty"] is not None:  # an empty pattern occurs in every text
            everywhere = F.struct(*[F.lit(shape["empty"][c]).alias(c) for c in ("ordinal", "name", "category")])
            own = F.struct("_hit.ordinal", "_hit.name", "_hit.category")
            tagged = tagged.withColumn("_hit", F.when(F.col("_text").isNull(), F.lit(None)).when(
                F.col("_hit").isNull() | (F.col("_hit.ordinal") > shape["empty"]["ordinal"]), everywhere).otherwise(own))
    return tagged.select(
        id_col,
        F.col("_hit").isNotNull().alias("blocked"),
        F.coalesce(F.col("_hit.name"), F.lit("")).alias("pattern"),
        F.col("_hit.category").alias("category"),
    )


def append_new_patterns(existing: DataFrame, incoming: DataFrame, order_col: str) -> DataFrame:
    """Append ``incoming`` names absent from ``existing`` (case-insensitive),
    keeping the first spelling of each new name in ``order_col`` order; new
    rows default to company ``unknown`` and category ``ai`` and get ordinals
    continuing after the current maximum (J8).

    ``incoming`` has ``name`` and ``order_col`` and may have ``company`` and
    ``category``. Duplicates are removed with a grouped ``min`` (partial
    aggregation), the existing names by a left anti join.
    """
    cols = incoming.columns
    company = F.col("company") if "company" in cols else F.lit(None).cast("string")
    category = F.col("category") if "category" in cols else F.lit(None).cast("string")
    firsts = (
        incoming.filter(F.col("name").isNotNull())
        .select(F.lower("name").alias("_k"),
                F.struct(F.col(order_col).alias("o"), F.col("name").alias("name"),
                         company.alias("company"), category.alias("category")).alias("s"))
        .groupBy("_k").agg(F.min("s").alias("s"))
    )
    known = existing.select(F.lower("name").alias("_k"))
    fresh = firsts.join(known, "_k", "left_anti").select(
        F.col("s.o").alias("_o"), F.col("s.name").alias("name"),
        F.coalesce(F.col("s.company"), F.lit(DEFAULT_COMPANY)).alias("company"),
        F.coalesce(F.col("s.category"), F.lit(DEFAULT_CATEGORY)).alias("category"),
    )
    top = F.coalesce(existing.agg(F.max("ordinal")).scalar(), F.lit(0))
    appended = number_rows(fresh, ["_o", "name"], out="_seq").select(
        (F.col("_seq") + top).alias("ordinal"), "name", "company", "category")
    return existing.select(F.col("ordinal").cast("long").alias("ordinal"), "name", "company", "category").unionByName(appended)


def category_stats(df: DataFrame, category_col: str = "category") -> DataFrame:
    """Count per category (missing → ``unknown``) plus a ``TOTAL`` row,
    largest first (A16).

    The input is aggregated once per category (partial aggregation); the
    total is a global sum over those few rows, so it exists (as 0) also for
    an empty input, where a ROLLUP in Spark would return nothing.
    """
    cat = F.coalesce(F.col(category_col), F.lit(MISSING_CATEGORY)).alias("category")
    per = df.select(cat).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    total = per.agg(F.lit("TOTAL").alias("category"),
                    F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"))
    return (
        total.withColumn("_g", F.lit(1)).unionByName(per.withColumn("_g", F.lit(0)))
        .orderBy(F.desc("_g"), F.desc("count"), "category").drop("_g")
    )


def hits_by_category(tagged: DataFrame) -> DataFrame:
    """Category statistics over the tagged rows that matched a pattern."""
    return category_stats(tagged.filter(F.col("blocked")))

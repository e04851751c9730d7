"""Spelling variants: words one edit apart, found by variable-length grams.

A word stands between two marks. From each place the shortest gram is taken and
made longer as long as it is frequent, up to the longest length; a gram that
lies within an earlier one is left out. Frequent grams, which extend others, are
those that make up more than a share of all places, so the dictionary is bounded
by construction, whatever the vocabulary.

Whether a gram is made longer depends only on what it holds so far. So an edit
changes the grams over it, and to the right of it those that a new gram may
swallow: gram [p, e) after the edited place i only if some character before
word[i+1 : e-1] makes a frequent gram. The most grams that any one edit can
affect is the word's bound. Two words one edit apart share at least the grams
of either less its bound, at equal places from the start or from the end.

List merging: with grams in order of rarity, two words that share at least two
grams share two among the first (bound + 2) of each. The lists of two such grams
are merged by joining on both grams, their places and the length; every pair
found is verified by its edit distance. Words that keep fewer than two grams
("short" ones) take part with all they have, and are compared with one another
by the words that one deletion makes of them, so nothing is missed.

What is shuffled grows with the vocabulary, not with the corpus: the corpus is
counted with a map-side combine. Rounds are checkpointed in the shared folder.

Defined results: NULL and empty texts have no words. A NULL id counts as the
empty text where the id takes part in a rule. Repeated rows count each. Words
without near words have ``n_near`` 0 and are their own root; of near words with
the same count the first in code-point order is the form. Longer texts cost in
proportion; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize, text_or_empty

#: Lengths of grams, and the share of all places from which on a gram is made longer.
SHORTEST, LONGEST, FREQUENT_SHARE = 2, 4, 1 / 2000
#: Grams with at least this share of all places are ordered by their count, rarer ones come first.
ORDERED_SHARE = 1 / 20000
#: A form has at least so many times the count of the word.
TIMES = 5
LETTERS = r"[A-Za-zÀ-ÿ]+"
_FIRST, _LAST = "\x02", "\x03"


def lower_ascii(word: str | Column) -> Column:
    """``word`` with only A-Z lower-cased."""
    w = F.col(word) if isinstance(word, str) else word
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, upper, lower))


def letter_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 6) -> DataFrame:
    """``(doc_id, word)``: every run of at least ``shortest`` letters, lower-cased (A-Z only)."""
    runs = F.explode(F.regexp_extract_all(text_or_empty(text), F.lit(LETTERS), F.lit(0)))
    return (df.select(F.col(doc_id).alias("doc_id"), runs.alias("run")).where(F.length("run") >= shortest)
            .select("doc_id", lower_ascii("run").alias("word")))


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """``(word, n)`` of the words of at least ``shortest`` letters that occur at least ``least`` times."""
    return (words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least))


class GramDictionary:
    """Cuts words into variable-length grams; ``counts`` are the listed grams' counts, ``frequent`` those that extend."""

    def __init__(self, counts: dict[str, int], frequent: set[str], shortest: int = SHORTEST, longest: int = LONGEST):
        self.counts, self.frequent, self.shortest, self.longest = counts, frequent, shortest, longest
        self.after_one = {g[1:] for g in frequent}

    def cut(self, s: str) -> list[tuple[int, int]]:
        """The grams of a marked word, as (start, end)."""
        grams, reached, frequent = [], 0, self.frequent
        for p in range(len(s) - self.shortest + 1):
            e = p + self.shortest
            while e < len(s) and e - p < self.longest and s[p:e] in frequent:
                e += 1
            if e > reached:
                grams.append((p, e))
                reached = e
        return grams

    def bound(self, s: str, grams: list[tuple[int, int]]) -> int:
        """The most grams of a marked word that one edit between its marks affects."""
        swallowed, most = self.after_one, 0
        for i in range(1, len(s)):
            # Put in before i, and (but for the last mark) i deleted or replaced.
            put = sum(1 for p, e in grams if p < i < e or (p >= i and s[i:e - 1] in swallowed))
            off = sum(1 for p, e in grams if p <= i < e or (p > i and s[i + 1:e - 1] in swallowed)) if i < len(s) - 1 else 0
            most = max(most, put, off)
        return most

    def keys(self, word: str) -> tuple[bool, list[int], list[int]]:
        """Whether the word is short; the keys of its merged lists; the keys at
        which a word that is one character longer has it."""
        s = _FIRST + word + _LAST
        grams = self.cut(s)
        bound = self.bound(s, grams)
        short = len(grams) - bound < 2
        if not short:
            rarest = sorted((self.counts.get(s[p:e], 0), s[p:e], p, e) for p, e in grams)
            grams = sorted((p, e) for *_, p, e in rarest[:bound + 2])
        own, longer = set(), set()
        for (p, e), (q, f) in combinations(grams, 2):
            a, b = s[p:e], s[q:f]
            own.add(_key(a, p, b, q, len(s)))
            for x, y in ((0, 0), (0, 1), (1, 1)):
                longer.add(_key(a, p + x, b, q + y, len(s) + 1))
        return short, list(own), list(longer)


def _key(a: str, p: int, b: str, q: int, size: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{a}\0{p}\0{b}\0{q}\0{size}") - (1 << 63)


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, share: float = FREQUENT_SHARE,
                    listed: float = ORDERED_SHARE) -> GramDictionary:
    """The dictionary of the column ``word``. The driver gets the grams above
    the ``listed`` share: at most (longest - shortest + 1) / listed of them."""
    marked = F.concat(F.lit(_FIRST), F.col("word"), F.lit(_LAST))
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    rows = words.select(marked.alias("s"))

    def cuts(q: int) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.length("s") - (q - 1)), lambda i: F.substr("s", i, F.lit(q)))
        return F.when(F.length("s") >= q, whole).otherwise(F.array().cast("array<string>"))

    every = F.concat(*map(cuts, range(shortest, longest + 1)))
    grams = rows.select(F.explode(every).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = {r["gram"]: r["n"] for r in grams.where(F.col("n") > places * min(share, listed)).collect()}
    return GramDictionary(found, {g for g, n in found.items() if shortest <= len(g) < longest and n > places * share}, shortest, longest)


def near_words(words: DataFrame, dictionary: GramDictionary | None = None) -> DataFrame:
    """``(a, b)``: all pairs of distinct words of the column ``word`` that differ
    by one inserted, deleted or replaced code point, each pair once."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary or gram_dictionary(words))  # bounded by the shares

    def start():
        grams = shared.value

        def compute(column: pa.Array) -> list:
            short, own, longer = zip(*map(grams.keys, column.to_pylist())) if len(column) else ((), (), ())
            return [pa.array(short, pa.bool_()), pa.array(own, pa.list_(pa.int64())), pa.array(longer, pa.list_(pa.int64()))]
        return compute

    lists = T.ArrayType(T.LongType())
    cut = materialize(append_columns(words.select("word"), "word", T.StructType().add("short", T.BooleanType())
                                     .add("own", lists).add("longer", lists), start))
    one_edit = F.levenshtein("a", "b", 1) == 1
    size = F.length("a")
    asks = cut.select(F.col("word").alias("a"), F.explode(F.concat("own", "longer")).alias("key"))
    has = cut.select(F.col("word").alias("b"), F.explode("own").alias("key"))
    merged = asks.join(has, "key").where(((size < F.length("b")) | ((size == F.length("b")) & (F.col("a") < F.col("b")))) & one_edit)
    made = F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(
        F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1))))
    less = cut.where("short").select("word", F.explode(F.array_distinct(made)).alias("left"))
    both = less.select(F.col("word").alias("a"), "left").join(less.select(F.col("word").alias("b"), "left"), "left")
    return merged.select("a", "b").union(both.where((F.col("a") < F.col("b")) & one_edit).select(
        F.when(size <= F.length("b"), F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(size <= F.length("b"), F.col("b")).otherwise(F.col("a")).alias("b"))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(of, root)`` from ``(of, up)``: each round doubles the steps taken. A
    form's count is ``TIMES`` the word's, so there are no rings and few rounds."""
    while True:
        above = forms.select(F.col("of").alias("at"), F.col("up").alias("next"))
        forms = materialize(forms.join(above, F.col("up") == F.col("at"), "left").select(
            "of", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if forms.where("moved").isEmpty():
            return forms.select("of", F.col("up").alias("root"))


def variant_groups(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``counts`` (word, n): the
    near word of largest count, if that is at least ``times`` the word's."""
    counts = materialize(counts.select("word", "n"))
    pairs = near_words(counts)
    sides = pairs.select(F.col("a").alias("of"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    best = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    near = (sides.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("of").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best")))
    found = counts.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"))
    found = materialize(found.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")))
    roots = _roots(found.where("form IS NOT NULL").select(F.col("word").alias("of"), F.col("form").alias("up")))
    return found.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

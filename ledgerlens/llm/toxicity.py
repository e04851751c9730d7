"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts and lexicon are folded alike: lower case without accents, homoglyphs of
other scripts as Latin letters, digits and signs that stand for letters as
those letters, look-alikes of one another (i, l, 1) as one, punctuation as
white space. Terms are whole words or beginnings of words.

Learning: of a bounded sample of labelled rows, every word and word beginning
gets the log ratio of its frequencies in toxic and clean documents; terms that
are frequent and one-sided enough form the lexicon, with that ratio as weight; a
beginning also needs several different words that have it in toxic documents.
What holds a term but is as common in clean documents as in toxic ones becomes an
exception phrase, beside any that the caller gives: words that only begin like a
term, and pairs of successive words with a term in them. A term found inside an
exception phrase doesn't count.

Scoring: the weights of the terms found are summed, divided by a mild function
of the text's length, and mapped to 0..1. Scoring is a map over whole texts in
time proportional to them; the lexicon is broadcast. It is bounded by the sample:
``TRAIN_ROWS`` rows, of which a term takes ``MIN_TOXIC`` and a phrase ``MIN_BENIGN``.

Defined results: NULL and empty texts have no terms and score 0. Labels with
NULL id or value are left out, of repeated labels the largest counts; repeated
rows are learned from and scored each. Of terms that begin at the same place the
heaviest counts. Without toxic rows the lexicon is empty; an empty table gives no
rows. Columns named like an output are replaced, others are kept.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize

#: The lexicon is learned from at most so many labelled rows, those with the least hash of their id.
TRAIN_ROWS = 30_000
#: A term needs so many toxic documents, this log ratio, and is a word or its first letters.
MIN_TOXIC, MIN_WEIGHT, PREFIXES = 4, 3.0, (4, 5, 6)
#: An exception phrase is in so many documents.
MIN_BENIGN = 3
THRESHOLD = 0.7

# What digits, signs and letters of other scripts stand for.
STAND_INS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss",
}
_PUNCTUATION = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in STAND_INS)
_FOLD = str.maketrans({**{c: " " for c in _PUNCTUATION}, **STAND_INS,
                       **{chr(c): None for c in range(0x300, 0x370)}, **{chr(c): None for c in range(0x200B, 0x200E)}})


def fold(text: str | None) -> str:
    """The folded text: words between single or more spaces."""
    text = (text or "").lower()
    return (text if text.isascii() else unicodedata.normalize("NFKD", text)).translate(_FOLD)


@dataclass
class Lexicon:
    """Weighted terms (a trailing space marks a whole word) and exception phrases, all folded."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    scale: float = 1.0

    def __post_init__(self):
        self.exceptions = [" ".join(fold(p).split()) for p in self.exceptions if fold(p).strip()]


class Scorer:
    """Scores texts with one automaton of terms and exception phrases."""

    def __init__(self, lexicon: Lexicon):
        self.scale, self.automaton = lexicon.scale, ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(" " + term, (len(term) + 1, weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _hits(self, words: list[str]) -> dict[int, float]:
        """Places in the joined words where terms begin outside exception phrases, with the heaviest term's weight."""
        hits: dict[int, float] = {}
        spans = []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        spans.sort()
        out, reach, k = {}, -1, 0
        for start in sorted(hits) if spans else hits:
            while k < len(spans) and spans[k][0] <= start:
                reach, k = max(reach, spans[k][1]), k + 1
            if start >= reach:
                out[start] = hits[start]
        return out

    def found(self, text: str | None) -> tuple[float, int]:
        """The summed weight of the terms found outside exceptions (of terms
        that begin at the same place, the heaviest), and the number of words."""
        words = fold(text).split()
        if not len(self.automaton) or not words:
            return 0.0, len(words)
        return sum(self._hits(words).values()), len(words)

    def phrases(self, text: str | None) -> list[str]:
        """The distinct words with a term in them, alone and with the word before or after."""
        words = fold(text).split()
        if not len(self.automaton) or not words:
            return []
        places = list(accumulate((len(w) + 1 for w in words), initial=0))  # of the space before each word
        out = set()
        for start in self._hits(words):
            i = bisect_right(places, start) - 1
            out |= {" ".join(words[a:b]) for a, b in ((i, i + 1), (i - 1, i + 1), (i, i + 2)) if a >= 0 and b <= len(words)}
        return sorted(out)

    def score(self, text: str | None) -> float:
        """0 (nothing found) to 1."""
        weight, words = self.found(text)
        return 1.0 - math.exp(-weight / (self.scale * length_norm(words)))


def length_norm(words: int) -> float:
    """How much longer texts dilute what is found in them."""
    return 1.0 + math.sqrt(words / 1000.0)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_lexicon(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                  exceptions: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon learned from the labelled rows that aren't held out."""
    known = (labels.select(F.col(doc_id).alias("lid"), F.col(label).alias("toxic"))
             .where("lid IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("lid")))
             .groupBy("lid").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("lid"), "lid").limit(train_rows))
    rows = materialize(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(known), F.col("id") == F.col("lid")).select("toxic", "text"))  # at most train_rows ids

    def terms_of(text: str | None) -> list[dict]:
        words, out = sorted(set(fold(text).split())), {}
        for w in words:
            out[w + " "] = (w, w)
            for p in (w[:k] for k in PREFIXES if len(w) > k):
                out[p] = (out.get(p, (w,))[0], w)  # words come in order
        return [{"term": t, "low": low, "high": high} for t, (low, high) in out.items()]

    def find_terms():
        kind = pa.list_(pa.struct([("term", pa.string()), ("low", pa.string()), ("high", pa.string())]))
        return lambda texts: [pa.array(map(terms_of, texts.to_pylist()), kind)]

    is_toxic = F.when(F.col("toxic") > 0, 1).otherwise(0)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(is_toxic), F.lit(0)).alias("toxic")).first()
    n_toxic, n_clean = sizes["toxic"], sizes["n"] - sizes["toxic"]
    if not n_toxic:
        return Lexicon({}, list(exceptions))

    def weighed(terms: DataFrame, *more: Column) -> DataFrame:
        """``term``, its documents ``n``, the toxic ones among them and its weight, of ``terms`` (toxic, term)."""
        counts = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"), *more)
        return counts.withColumn("weight", F.ln((F.col("toxic") + 0.5) / (n_toxic + 1))
                                 - F.ln((F.col("n") - F.col("toxic") + 0.5) / (n_clean + 1)))

    listed = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("term", "low", "high")]))
    holding = append_columns(rows, "text", T.StructType().add("terms", listed), find_terms)
    counts = weighed(holding.select(is_toxic.alias("toxic"), F.inline("terms")), F.min(F.when(F.col("toxic") > 0, F.col("low"))).alias("low"),
                     F.max(F.when(F.col("toxic") > 0, F.col("high"))).alias("high"))
    # A beginning says more than a word only if toxic documents have several words with it.
    telling = F.col("term").endswith(" ") | (F.col("low") != F.col("high"))
    kept = counts.where(telling & (F.col("toxic") >= MIN_TOXIC) & (F.col("weight") >= MIN_WEIGHT)).select("term", "weight")
    terms = {r["term"]: r["weight"] for r in kept.collect()}

    def find_phrases():
        scorer = Scorer(Lexicon(terms, list(exceptions)))
        return lambda texts: [pa.array(map(scorer.phrases, texts.to_pylist()), pa.list_(pa.string()))]

    holding = append_columns(rows, "text", T.StructType().add("phrases", T.ArrayType(T.StringType())), find_phrases)
    benign = weighed(holding.select(is_toxic.alias("toxic"), F.explode("phrases").alias("term")))
    benign = benign.where((F.col("n") >= MIN_BENIGN) & (F.col("weight") <= 0)).collect()
    found = Lexicon(terms, [*exceptions, *sorted(r["term"] for r in benign)])
    found.scale = _fit_scale(rows, found)
    return found


def _fit_scale(rows: DataFrame, lexicon: Lexicon) -> float:
    """The scale under which the threshold errs least on the training rows.

    A row is called toxic where weight / length norm is at least scale * cut;
    the rows' densities are summed up in a histogram, of as many bins as training
    rows at most, the only thing gathered.
    """
    cut = -math.log(1.0 - THRESHOLD)

    def start():
        scorer = Scorer(lexicon)

        def compute(texts):
            found = [scorer.found(t) for t in texts.to_pylist()]
            return [pa.array([w / length_norm(n) for w, n in found], pa.float64())]
        return compute

    bins = append_columns(rows, "text", T.StructType().add("density", T.DoubleType()), start).groupBy(
        F.floor(F.col("density") * 4).alias("bin")).agg(
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    # A cut may lie after any bin but at 1 at least; up to the next bin it makes the same errors.
    tally = sorted((r["bin"], r["toxic"], r["n"] - r["toxic"]) for r in bins)
    edges = [0, *(b for b, *_ in tally if b > 0)]
    errors = {b: sum(t for k, t, _ in tally if k <= b) + sum(c for k, _, c in tally if k > b) for b in edges}
    best = min(errors.values())
    low, high = max(((b, c) for b, c in zip(edges, [*edges[1:], edges[-1] + 1]) if errors[b] == best), key=lambda e: (e[1] - e[0], -e[0]))
    return (low + 1 + high) / 2 / 4 / cut


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 at ``threshold`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the training sample

    def start():
        scorer = Scorer(shared.value)
        return lambda texts: [pa.array(map(scorer.score, texts.to_pylist()), pa.float64())]

    scored = append_columns(docs, text, T.StructType().add("score", T.DoubleType()), start)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Document quality by hierarchical empirical Bayes, with native functions.

Evidence of a document: a few shape features of its text (symbols, capitals,
repeats, word lengths) are binned at fixed cuts; the bins' frequencies among
good and bad labelled documents give a log likelihood ratio each (naive Bayes).

Prior of a document: the share of good documents of its path (host and section),
shrunk toward its host's, shrunk in turn toward the global share. How strongly
follows from the data, by the method of moments: the less hosts (paths) differ
beyond what chance explains, the more labels one needs to stand apart. A host or
path without labels has the prior above it.

All counts are grouped aggregates of whole tables, pre-aggregated map-side. The
driver receives the bins' counts and a few sums, whose number is fixed. Posteriors
per host and path are broadcast to the documents' scan where a bounded count
proves them few, so texts aren't shuffled; beyond, they are joined.

Defined results: NULL text counts as empty, NULL hosts and sections as groups of
their own; labels with NULL id or label are left out, and repeated labels count
each. Without labels every document has the global share 1/2. Repeated rows are
scored each; a score of exactly the threshold is kept. Features take one pass
over a text, however long. An empty table gives no rows. ``keep_good`` keeps all
columns as they are, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_count

from .common import fresh_name, let, materialize, text_or_empty

#: Upper cuts of the bins of each feature.
CUTS = {
    "symbols": (0.002, 0.01, 0.03, 0.08, 0.2),
    "capitals": (0.03, 0.06, 0.12, 0.25, 0.5),
    "repeats": (0.02, 0.05, 0.1, 0.3, 0.6),
    "word_length": (3.5, 4.5, 5.5, 6.5, 8.0, 11.0),
}
#: Documents with at least this probability of being good are kept.
THRESHOLD = 0.5
#: Posteriors of at most so many paths (and hosts) are broadcast.
BROADCAST_PATHS = 500_000
_STRENGTH = (1.0, 1e6)
_MADE = ("host_posterior", "path_posterior", "evidence", "score", "kept")


def _bins(text: Column) -> dict[str, Column]:
    """The bin number of each feature."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    same = lambda found: F.size(F.filter(found, lambda w, i: (i > 0) & (w == F.get(found, i - 1))))
    of_words = let(words, lambda found: F.struct(F.greatest(F.size(found), F.lit(1)).alias("n"), same(found).alias("same")))
    shares = {
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'()-]")) / n,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / n,
        "repeats": let(of_words, lambda c: c["same"] / c["n"]),
        "word_length": n / of_words["n"],
    }
    cut = lambda name: lambda share: sum((share > c).cast("int") for c in CUTS[name])
    return {name: let(share, cut(name)) for name, share in shares.items()}


@dataclass
class Model:
    """What is learned: evidence per bin, and the strengths of the priors."""

    share: float
    host_strength: float
    path_strength: float
    evidence: dict[str, list[float]]


def _strength(share_variance: float, spread: float, groups: int, total: int) -> float:
    """How many labels the prior above counts for, by the method of moments:
    ``spread`` is the weighted mean square of the groups' deviations, of which
    chance alone makes ``share_variance`` * (groups - 1) / total."""
    low, high = _STRENGTH
    if total == 0:
        return high
    beyond = spread - share_variance * max(groups - 1, 0) / total
    return min(high, max(low, share_variance / beyond - 1)) if beyond > 0 else high


def _shrunk(good: str, total: str, prior: Column, strength: float) -> Column:
    return (F.col(good) + F.lit(strength) * prior) / (F.col(total) + F.lit(strength))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
        section: str = "lang", label: str = "quality") -> tuple[Model, DataFrame]:
    """The model, and ``(host, section, host_posterior, path_posterior)`` of all labelled paths."""
    known = labels.select(F.col(doc_id).alias("lid"), F.col(label).alias("y")).where("lid IS NOT NULL AND y IS NOT NULL")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.col(section).alias("section"),
                       *[b.alias(name) for name, b in _bins(text_or_empty(text)).items()])
    train = rows.join(known, F.col("id") == F.col("lid"))

    # One pass over the labelled rows; what follows works on these counts, (paths x bins) rows at most.
    cells = materialize(train.groupBy("host", "section", *CUTS).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("good")))
    paths = cells.groupBy("host", "section").agg(F.sum("total").alias("total"), F.sum("good").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("total").alias("h_total"), F.sum("good").alias("h_good"))

    counts = cells.select("total", "good", F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).alias("bin")) for name in CUTS])).alias("f"))
    counts = counts.groupBy("f.feature", "f.bin").agg(F.sum("good").alias("good"), F.sum("total").alias("total")).collect()
    good = {(r["feature"], r["bin"]): r["good"] for r in counts}
    every = {(r["feature"], r["bin"]): r["total"] for r in counts}
    name = next(iter(CUTS))
    n_good = sum(v for (f, _), v in good.items() if f == name)
    n = sum(v for (f, _), v in every.items() if f == name)
    evidence = {}
    for feature, cuts in CUTS.items():
        bins = range(len(cuts) + 1)
        evidence[feature] = [math.log((good.get((feature, b), 0) + 1) / (n_good + len(bins)))
                             - math.log((every.get((feature, b), 0) - good.get((feature, b), 0) + 1) / (n - n_good + len(bins)))
                             for b in bins]

    share = (n_good + 1) / (n + 2)
    variance = share * (1 - share)
    off = (F.col("h_good") / F.col("h_total") - F.lit(share))
    h = hosts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h_total") * off * off).alias("s")).first()
    host_strength = _strength(variance, (h["s"] or 0.0) / max(n, 1), h["n"], n)
    hosts = hosts.withColumn("host_posterior", _shrunk("h_good", "h_total", F.lit(share), host_strength))

    renamed = hosts.select(F.col("host").alias("of"), "host_posterior")
    joined = paths.join(renamed, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    off = F.col("good") / F.col("total") - F.col("host_posterior")
    p = joined.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("total") * off * off).alias("s")).first()
    path_strength = _strength(variance, (p["s"] or 0.0) / max(n, 1), p["n"] - h["n"] + 1, n)
    joined = joined.withColumn("path_posterior", _shrunk("good", "total", F.col("host_posterior"), path_strength))
    return (Model(share, host_strength, path_strength, evidence),
            joined.select("host", "section", "host_posterior", "path_posterior"))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          section: str = "lang", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``host_posterior``, ``path_posterior``, ``evidence`` (log
    likelihood ratio), ``score`` (probability of being good) and ``kept``.
    Columns of these names are replaced."""
    model, paths = fit(docs, labels, doc_id, text, host, section, label)
    paths = materialize(paths)
    few = bounded_count(paths, BROADCAST_PATHS) <= BROADCAST_PATHS
    small = F.broadcast if few else lambda side: side
    hosts = paths.groupBy("host").agg(F.first("host_posterior").alias("host_posterior"))
    rest = docs.drop(*[c for c in docs.columns if c.lower() in _MADE])
    h, hp, ph, ps, pp = (fresh_name(rest, x) for x in ("_h", "_hp", "_ph", "_ps", "_pp"))
    bins = _bins(text_or_empty(text))
    evidence = reduce(lambda a, b: a + b, [
        F.get(F.array(*[F.lit(v) for v in model.evidence[name]]), bins[name]) for name in CUTS])
    out = (rest.join(small(paths.select(F.col("host").alias(ph), F.col("section").alias(ps), F.col("path_posterior").alias(pp))),
                     F.col(host).eqNullSafe(F.col(ph)) & F.col(section).eqNullSafe(F.col(ps)), "left")
           .join(small(hosts.select(F.col("host").alias(h), F.col("host_posterior").alias(hp))), F.col(host).eqNullSafe(F.col(h)), "left")
           .withColumn("host_posterior", F.coalesce(F.col(hp), F.lit(model.share)))
           .withColumn("path_posterior", F.coalesce(F.col(pp), F.col("host_posterior")))
           .drop(h, hp, ph, ps, pp)
           .withColumn("evidence", evidence))
    odds = F.ln(F.col("path_posterior") / (1 - F.col("path_posterior"))) + F.col("evidence")
    return out.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents scored as good, with their own columns."""
    hidden = {c: fresh_name(docs, "_doc_" + c) for c in docs.columns if c.lower() in _MADE}
    scored = score(docs.withColumnsRenamed(hidden), labels, **how).where("kept")
    return scored.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])

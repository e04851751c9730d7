"""Periodic runs of words, found by recursive frequency splitting.

A run is a stretch of successive words with smallest period q that no neighbour
extends, at least ``least_words`` long and ``REPEATS`` periods. So every word of a
run stands in it at least ``REPEATS`` times: a word that is rarer than that within
a segment belongs to no run in it, and splits it. Splitting goes on until every
word of every segment is frequent enough there; of ordinary text little survives.

The surviving segments are scanned lag by lag. A run of period q holds at least
``REPEATS`` - 1 whole blocks of q words that begin at multiples of q, all equal: so
for each lag the hashes of the segment's blocks are compared with their
neighbours', and each series of equal blocks is extended word by word. All lags
together take segment length / lag blocks each, so a segment of m words costs
m log m, not m squared. A stretch found at a lag that it was found at a divisor
of already has the smaller period.

Documents are mapped one by one, with no shuffle; a task holds a block of texts.

Defined results: words are what white space (space, tab to carriage return)
separates, unchanged; NULL and empty texts have none, and no runs. Very long
texts are worked on whole, in memory in proportion to them. Repeated rows each
get their result; rows without id are rows like others. An empty table gives no
rows. Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: A run is at least so many periods and so many words long.
REPEATS, LEAST_WORDS = 4, 6
#: Blocks compared at once.
_AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MADE = T.StructType().add("n_words", T.LongType()).add("runs", T.ArrayType(_RUN)).add("collapsed", T.StringType())


def frequent_segments(ids: np.ndarray, repeats: int = REPEATS, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """The segments (first, after) left when words that occur fewer than
    ``repeats`` times within their segment have split it, again and again.

    The largest part of a split is counted by taking the others away, so a word
    is looked at a logarithmic number of times, however many rounds there are.
    """
    counts = np.bincount(ids)
    rare = np.flatnonzero(counts[ids] < repeats)
    by_word = begins = None
    out, todo = [], [(0, len(ids), np.arange(len(counts)), counts, rare)]
    while todo:
        lo, hi, words, counts, rare = todo.pop()  # counts of its words in this segment, and the places of those too rare
        if not len(rare):
            if hi - lo >= least_words:
                out.append((lo, hi))
            continue
        firsts, afters = np.concatenate([[lo], rare + 1]), np.concatenate([rare, [hi]])
        sizes = afters - firsts
        largest = int(np.argmax(sizes))
        for k in np.flatnonzero(sizes >= least_words).tolist():
            a, b = int(firsts[k]), int(afters[k])
            if k != largest or 2 * (b - a) < hi - lo:
                own, inverse, new = np.unique(ids[a:b], return_inverse=True, return_counts=True)
                todo.append((a, b, own, new, a + np.flatnonzero(new[inverse] < repeats)))
                continue
            if by_word is None:  # the places of each word, for long texts that are split off bit by bit
                by_word = np.argsort(ids, kind="stable")
                begins = np.searchsorted(ids[by_word], np.arange(int(ids.max()) + 2))
            gone, lost = np.unique(np.concatenate([ids[lo:a], ids[b:hi]]), return_counts=True)
            at = np.searchsorted(words, gone)
            counts[at] -= lost
            few = gone[(counts[at] > 0) & (counts[at] < repeats)]
            places = [p[np.searchsorted(p, a):np.searchsorted(p, b)] for p in (by_word[begins[w]:begins[w + 1]] for w in few.tolist())]
            todo.append((a, b, words, counts, np.sort(np.concatenate(places)) if places else few[:0]))
    return sorted(out)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def scan_lags(s: np.ndarray, repeats: int = REPEATS, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one segment."""
    m = len(s)
    powers = np.cumprod(np.full(m, _BASE, np.uint64))
    inverse = np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), np.uint64))
    mixed = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * powers)])
    found: list[tuple[int, int, int]] = []
    lags = np.arange(1, m // repeats + 1)
    blocks = np.cumsum(m // lags)
    done = 0
    while done < len(lags):
        upto = max(done + 1, int(np.searchsorted(blocks, (blocks[done - 1] if done else 0) + _AT_ONCE)))
        some = lags[done:upto]
        per_lag = m // some
        lag = np.repeat(some, per_lag)
        begin = (np.arange(len(lag)) - np.repeat(np.cumsum(per_lag) - per_lag, per_lag)) * lag
        hashes = (sums[begin + lag] - sums[begin]) * inverse[begin]
        equal = (hashes[1:] == hashes[:-1]) & (lag[1:] == lag[:-1])
        firsts, lasts = _stretches(equal)
        enough = lasts - firsts >= repeats - 2
        for k, n in zip(firsts[enough].tolist(), (lasts - firsts)[enough].tolist()):
            _extend(s, int(lag[k]), int(begin[k]), n + 1, found, repeats, least_words)
        done = upto
    return found


def _extend(s: np.ndarray, q: int, begin: int, blocks: int, found: list, repeats: int, least_words: int) -> None:
    """Add the run of period ``q`` that holds the equal blocks from ``begin`` on,
    unless it lies in a run of a smaller period (and so has one itself)."""
    end = begin + blocks * q
    if any(r <= begin and end <= r + n for r, n, _ in found):
        return
    lo, hi = max(0, begin - q), min(len(s), end + q)
    for a, b in zip(*_stretches(s[lo:hi - q] == s[lo + q:hi])):
        start, length = lo + int(a), int(b - a) + q
        if length >= max(least_words, repeats * q) and not any(r <= start and start + length <= r + n for r, n, _ in found):
            found.append((start, length, q))


def find_runs(ids: np.ndarray, repeats: int = REPEATS, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period."""
    return sorted((lo + start, length, q) for lo, hi in frequent_segments(ids, repeats, least_words)
                  for start, length, q in scan_lags(ids[lo:hi], repeats, least_words))


def collapse(n_words: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    edges = np.zeros(n_words + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(df: DataFrame, text: str = "text", repeats: int = REPEATS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (by start, then period) and
    ``collapsed``, the words outside repeats joined by single spaces."""
    if repeats < 3:
        raise ValueError("runs of fewer than three periods need not hold two equal blocks")

    def one(value: str | None) -> tuple[int, list, str]:
        words = (value or "").encode().split()  # bytes: only ASCII white space
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        runs = find_runs(ids, repeats, least_words) if len(words) >= least_words else []
        if runs:
            stays = collapse(len(words), runs)
            kept = [w for w, stay in zip(words, stays.tolist()) if stay]
        return len(words), runs, b" ".join(kept if runs else words).decode()

    def start():
        def compute(texts: pa.Array) -> list:
            n, runs, kept = zip(*map(one, texts.to_pylist()))
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
            return [pa.array(n, pa.int64()), pa.array(rows, _ARROW_RUNS), pa.array(kept, pa.string())]
        return compute

    return append_columns(df, text, _MADE, start)

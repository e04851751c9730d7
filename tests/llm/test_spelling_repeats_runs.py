"""Spelling variants, repeated passages and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import periodic, queries, repeats, spelling


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def white(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def documents(tmp_path, spark, rows, name="documents"):
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, word string, n_words long").repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return folder


# ---------------------------------------------------------------- spelling (11)

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, times=5):
    near = {w: [x for x in counts if x != w and one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def words_close_to_one_another(n, seed, alphabet="abé"):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(6, 12))) for _ in range(n // 6)]
    out = set(base)
    while len(out) < n:
        w = rnd.choice(sorted(out)[:n // 2])
        i = rnd.randrange(len(w) + 1)
        out.add(rnd.choice([w[:i] + rnd.choice(alphabet) + w[i:], w[:i] + w[i + 1:], w[:i] + rnd.choice(alphabet) + w[i + 1:]]))
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("share, longest", [(1 / 2000, 4), (1 / 60, 4), (1 / 400, 7), (2, 2)])
def test_near_words_match_brute_force(spark, share, longest):
    words = words_close_to_one_another(500, 3) + ["a", "ab", "b", ""]
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    grams = spelling.gram_dictionary(frame, longest=longest, share=share, listed=share / 4)
    got = [frozenset(r) for r in spelling.near_words(frame, grams).collect()]
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_grams_within_the_bound_stay(spark):
    """Of a word and of all words one edit away, at least the grams less the bound are the same."""
    words = words_close_to_one_another(120, 5)
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for share, longest in ((1 / 40, 4), (1 / 300, 6)):
        d = spelling.gram_dictionary(frame, longest=longest, share=share, listed=share)
        for w in words[:40]:
            s = f"\x02{w}\x03"
            grams = d.cut(s)
            bound = d.bound(s, grams)
            for i in range(1, len(s)):
                edits = [(s[:i] + c + s[i:], 1) for c in "abéz"]
                if i < len(s) - 1:
                    edits += [(s[:i] + s[i + 1:], -1)] + [(s[:i] + c + s[i + 1:], 0) for c in "abéz" if c != s[i]]
                for t, by in edits:
                    there = {(p, t[p:e]) for p, e in d.cut(t)}
                    left = sum((p, s[p:e]) in there if p < i else (p + by, s[p:e]) in there for p, e in grams)
                    assert left >= len(grams) - bound, (s, t, grams)


def test_spelling_query_matches_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    words = words_close_to_one_another(150, 7, "abÀÉé") + ["Colour", "color", "colours", "x", "fünf", "×ßabcdé"]
    weights = [rnd.choice([1, 1, 5, 40, 300]) for _ in words]
    rows = [(i if i % 40 else None, " ".join(w.upper() if rnd.random() < 0.1 else w + rnd.choice(["", "", ",", "3"])
                                            for w in rnd.choices(words, weights, k=rnd.randint(0, 120))), "e", 1) for i in range(200)]
    rows += [(500, None, "e", 1), (501, "", "e", 1), (502, "colour " * 3000, "e", 1), rows[3], rows[3]]
    counts = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = queries.op11_spelling(spark, documents(tmp_path, spark, rows)).collect()
    assert {tuple(r) for r in got} == plain_variants(counts) and len(got) == len(counts) > 100
    assert any(r["form"] and r["root"] != r["form"] for r in got)


def test_spelling_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.vocabulary(spelling.letter_runs(empty))).collect() == []
    one = spark.createDataFrame([("word", 9)], "word string, n long")
    assert [tuple(r) for r in spelling.variant_groups(one).collect()] == [("word", None, "word", 9, 0, None)]


# ---------------------------------------------------------------- repeated passages (12)

def plain_repeats(rows, window):
    ids = [(1 << 63) - 1 if d is None else d for d, *_ in rows]
    texts = [white(t) for _, t, *_ in rows]
    first = {}
    for d, words in zip(ids, texts):
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            first[w] = min(first.get(w, d), d)
    out = []
    for (raw, *_), d, words in zip(rows, ids, texts):
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s:s + window])] < d:
                gone.update(range(s, s + window))
        out.append((raw, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def repeats_case(window):
    rnd = random.Random(11)
    say = lambda n: [f"w{rnd.randrange(50)}" for _ in range(n)]
    shared = [say(rnd.randint(window, 4 * window)) for _ in range(5)] + [say(window), say(window - 1)]
    rows = []
    for i in range(150):
        body = say(rnd.randint(0, 3 * window))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            at = rnd.randrange(len(body) + 1)
            body[at:at] = rnd.choice([p, p, p[a:], p[:a], p + p])
        rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice([" ", "\n", " \t "]).join(body) + rnd.choice(["", " ", "\r\n"]), "e", 5))
    long = say(3000)
    rows += [(900, " ".join(long), "e", 5), (901, " ".join(long[:1500] + ["new"] + long[1500:]), "e", 5), rows[3], rows[3], rows[7],
             (-5, rows[3][1], "e", 5), (902, None, "e", 5), (903, "", "e", 5), (904, "one word   é", "e", 5), (905, "x " * 400, "e", 5),
             (906, "x " * 300, "e", 5)]
    return rows


@pytest.mark.parametrize("block, batch", [(8 << 20, 10000), (3000, 7)])
def test_repeats_match_brute_force(spark, monkeypatch, block, batch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = repeats_case(12)
        frame = spark.createDataFrame(rows, "doc_id long, text string, _key string, n_words long").repartition(3)
        got = repeats.drop_repeats(frame, window=12)
        assert got.columns == ["doc_id", "text", "_key", "n_words", "n_removed"]
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()]
        want = plain_repeats(rows, 12)
        assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] > 0 for r in want) > 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_without_broadcast(spark, monkeypatch):
    rows = repeats_case(12)
    frame = spark.createDataFrame(rows, "doc_id long, text string, _key string, n_words long")
    monkeypatch.setattr(repeats, "BROADCAST_DOCS", 1)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in repeats.drop_repeats(frame, window=12).collect()]
    assert sorted(got, key=str) == sorted(plain_repeats(rows, 12), key=str)


def test_repeats_query(spark, tmp_path):
    rows = repeats_case(50)
    got = queries.op12_substring_dedup(spark, documents(tmp_path, spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, n, k, sha(t)) for d, n, k, t in plain_repeats(rows, 50)), key=str)
    unique = [(i, t, "e", 5) for i, (_, t, *_) in enumerate(rows)]
    got = repeats.drop_repeats(spark.createDataFrame(unique, "doc_id long, text string, word string, n_words long")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == sorted(plain_repeats(unique, 50))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.drop_repeats(empty).collect() == [] and repeats.removal_intervals(empty).collect() == []


def test_a_common_passage_is_sent_once_a_block(spark):
    """Of a passage in every document, one occurrence per task crosses the shuffle."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} own{i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["id"]: [tuple(x) for x in r["intervals"]] for r in repeats.removal_intervals(frame).collect()}
    assert found == {i: [(0, 60)] for i in range(1, 400)}
    ids, keys = np.arange(100), np.arange(100)
    blocks = list(repeats._count_block(ids, keys, [t.encode() for _, t in rows[:100]], 50, 7))
    counted = sum(len(v) for v in blocks[-1].column(5).to_pylist())
    assert len(blocks) == 2 and counted == 11 + 100  # the passage once, and each document's last window


def test_rows_go_through_packing():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 5, 4000):
        bucket, ids = rnd.integers(0, 9, n), rnd.choice([-(1 << 63), -5, 0, 3, 1 << 40, (1 << 63) - 1], n)
        keys, start = rnd.integers(-2, 2, n), rnd.choice([0, 1, 127, 128, 70_000, 1 << 30], n)
        order = np.lexsort((start, keys, ids, bucket))
        bucket, ids, keys, start = (c[order] for c in (bucket, ids, keys, start))
        hashes, checks = rnd.integers(0, 1 << 60, n).astype(np.uint64), rnd.integers(-5, 5, n).astype(np.int16)
        batch = repeats._packed(bucket, ids, keys, start, hashes, checks)
        assert batch.num_rows == len(set(bucket.tolist()))
        for a, b in zip(repeats._unpacked(batch), (ids, keys, start)):
            assert (a == b).all() and len(a) == n
        assert (repeats._flat(batch.column(5)) == hashes.view(np.int64)).all() and (repeats._flat(batch.column(6)) == checks).all()


def test_rolling_hashes():
    rnd = np.random.default_rng(2)
    values = rnd.integers(0, 3, 300).astype(np.uint64)
    for window in (1, 2, 5, 50, 300, 301):
        h = repeats.rolling_hashes(values, window, repeats._BASES[0])
        windows = [tuple(values[i:i + window]) for i in range(len(values) - window + 1)]
        assert len(h) == len(windows) and len(set(zip(h, windows))) == len(set(windows)) == len(set(h))


# ---------------------------------------------------------------- periodic runs (13)

def plain_runs(words, repeats=4, least=6):
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.append((i, j - i + q, q))
            i = j + 1
    # A stretch of a smaller period too isn't one of period q.
    return sorted((s, k, q) for s, k, q in found if not any(q % d == 0 and all(
        words[i] == words[i + d] for i in range(s, s + k - d)) for d in range(1, q)))


def plain_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]


def run_texts():
    rnd = random.Random(6)
    texts = []
    for _ in range(250):
        words = []
        for _ in range(rnd.randint(0, 6)):
            unit = [rnd.choice("abcde") for _ in range(rnd.randint(1, 7))]
            words += unit * rnd.choice([1, 2, 4, 5, 9]) + unit[:rnd.randrange(len(unit) + 1)]
            words += [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 6))]
        texts.append(words)
    nested = (["a"] * 8 + ["b"]) * 5 + ["a"] * 3
    return texts + [[], ["a"] * 5, ["a"] * 6, ["a", "b"] * 2, ["a", "b"] * 4, ["a"] * 40, nested, nested * 4, list("abcabcabcabc"), ["x"] * 3000]


def test_runs_match_brute_force():
    for words in run_texts():
        numbers = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        got = periodic.find_runs(ids) if len(ids) else []
        if len(words) < 2000:
            assert got == plain_runs(words), words
        stays = periodic.collapse(len(words), got)
        assert [w for w, k in zip(words, stays) if k] == plain_collapse(words, got)
    assert got == [(0, 3000, 1)]


def test_segments_split_to_stability():
    rnd = random.Random(8)
    for size, kinds in ((50, 4), (400, 60), (3000, 500), (3000, 12)):
        ids = np.array([rnd.randrange(kinds) for _ in range(size)], np.int64)
        want, todo = [], [(0, size)]
        while todo:
            a, b = todo.pop()
            counts = Counter(ids[a:b].tolist())
            cuts = [i for i in range(a, b) if counts[ids[i]] < 4]
            if not cuts and b - a >= 6:
                want.append((a, b))
            elif cuts:
                todo += [(x + 1, y) for x, y in zip([a - 1, *cuts], [*cuts, b]) if y - x - 1 >= 6]
        assert periodic.frequent_segments(ids) == sorted(want)
    n = 30_000
    chain = np.repeat(np.arange(n), 4)[2:-1]
    assert periodic.frequent_segments(chain) == [(2, 2 + 4 * (n - 2))]
    # Each split makes just the next word too rare: rounds grow with the text.
    peeled = (np.arange(n)[:, None] + np.array([1, 0, 0, 0])).ravel()
    assert periodic.frequent_segments(peeled) == []


def test_runs_query(spark, tmp_path):
    texts = run_texts()
    rows = [(i if i % 31 else None, rnd_join(i, w), "e", 1) for i, w in enumerate(texts)] + [(900, None, "e", 1), (901, "", "e", 1), (902, "é é " * 30, "e", 1)]
    rows += [rows[5], rows[5]]
    want = []
    for d, text, *_ in rows:
        words = white(text)
        n, h = len(words), zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 2000 else [(0, n, 1)]
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        want.append((d, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(plain_collapse(words, runs)))))
    got = queries.op13_periodic_runs(spark, documents(tmp_path, spark, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(h[0] is not None and zlib.crc32(str(h[0]).encode()) % 10 == 0 for h in rows) > 10


def rnd_join(i, words):
    return (" ", "\n", "\t ")[i % 3].join(words)


def test_runs_keep_columns_and_take_odd_tables(spark):
    frame = spark.createDataFrame([(1, "a a a a a a", "r", 7), (1, None, None, None)], "doc_id long, text string, runs string, other long")
    got = periodic.periodic_runs(frame)
    assert sorted(got.columns) == ["collapsed", "doc_id", "n_words", "other", "runs", "text"]
    assert sorted((r["n_words"], len(r["runs"]), r["collapsed"]) for r in got.collect()) == [(0, 0, ""), (6, 1, "a")]
    assert periodic.periodic_runs(frame.limit(0)).collect() == []


def test_a_very_long_periodic_text():
    unit = np.arange(20_000)
    ids = np.concatenate([unit] * 10 + [unit[:77]])
    assert periodic.find_runs(ids) == [(0, 200_077, 20_000)]
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]

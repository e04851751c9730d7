"""SimHash components and exact groups against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import components, exact_dedup, queries, simhash


def plain_fingerprint(text, k=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, bits=3):
    """Least id per fingerprint's component, all pairs compared."""
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for f, i in zip(fps, ids):
        if i is not None:
            least[root(f)].append(i)
    return [min(least[root(f)], default=None) for f in fps]


def test_fingerprint():
    for t in (None, "", " \t\r\x0b\x0c", "one", "One TWO", "a b c", "A b\nC d É é", "x y z w q " * 50, "the " * 70000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_query_matches_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(d["text"]) for d in docs]
    want = dict(zip([d["doc_id"] for d in docs], zip(fps, plain_components(fps, [d["doc_id"] for d in docs]))))
    got = queries.op8_simhash(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (int(r["fingerprint"], 16), r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("home_block, copy_block", [(4096, 1 << 16), (3, 1 << 16), (4096, 5), (2, 7)])
def test_links_lose_no_component(spark, home_block, copy_block):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 1, 7, 1 << 63}
    for f in list(fps)[:50]:
        for bits in range(1, 5):  # neighbours at every distance up to one too far
            g = f
            for b in rnd.sample(range(64), bits):
                g ^= 1 << b
            fps.add(g)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << b) for b in range(64)}  # a dense group
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, home_block, copy_block)
    assert links.where("bit_count(a ^ b) > 3").count() == 0
    labels = {r["node"]: r["label"] for r in components.connected_components(links).collect()}
    want = plain_components(fps, list(range(len(fps))))
    groups = defaultdict(set)
    for f, w in zip(signed, want):
        groups[w].add(labels.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base, "y"), (3, base, "y"), (None, base, "z"), (None, None, "n"), (9, "", "e"), (8, "  ", "s"),
            (1, "other text entirely here", "o"), (1, "a second text with the same id", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted([(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()], key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (None, 8), (9, 8), (8, 8), (1, 1), (1, 1)], key=str)
    kept = sorted((r["doc_id"], r["fp"]) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [(1, "o"), (1, "p"), (3, "y"), (8, "s")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(df, max_bits=4)


def test_large_groups_are_joined_by_broadcast(spark, monkeypatch):
    """A third of all rows alike, and a bound that groups of later rounds pass too."""
    rnd = random.Random(9)
    long = "x" * 700
    texts = ["same"] * 300 + [long] * 120 + [long + "y"] * 90 + [f"text {rnd.randrange(60)}" for _ in range(400)] + [None, ""]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    want = defaultdict(list)
    for i, t in rows:
        want[t or ""].append(i)
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", 20)
    for size in (8 << 20, 1):
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", size)
        got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert len(got) == len(rows)
        seen = sorted(((r["text_sha256"], r["group_size"], r["keep_id"]) for r in got))
        assert seen == sorted((hashlib.sha256(t.encode()).hexdigest(), len(ids), max(i for i in ids if i is not None))
                              for t, ids in want.items() for _ in ids if any(i is not None for i in ids))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 4), (-5, 200)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: -5, 201: -5, -5: -5}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_match_brute_force(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcé") for _ in range(9000))
    texts = [long, long[:-1] + "x", long, long[:8191], long[:8191], "", None, "é" * 16, "é" * 16, "é" * 17, "a" * 32, "a" * 33,
             "a" * 33, "a" * 512, "a" * 513, "a" * 513, "b" * 140000, "b" * 140000, "b" * 139999 + "c"] + [f"t{i % 9}" for i in range(60)]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(50, "t1", -1), (50, "t1", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body int").repartition(4)
    members = defaultdict(list)
    for i, t, _ in rows:
        members[t or ""].append(i)
    largest = {t: max((i for i in m if i is not None), default=None) for t, m in members.items()}
    want = sorted(((i, largest[t or ""], len(members[t or ""]), i == largest[t or ""],
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, exact_dedup.exact_groups(df).collect()), key=str) == want
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted([(r["doc_id"], r["text"] or "") for r in kept.collect()], key=str) == \
        sorted([(largest[t], t) for t in members], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0

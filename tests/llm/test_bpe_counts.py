"""Encoding, decoding and token counts against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, bpe_vocab, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "aa", "é", "ß", "中", "😀", "1", "²", "'s", "'t", "<|endoftext|>", "<|endo", "!", "_",
         "\x1c", "\x85", "the", " and", "́", "Ⅷ", "٣", "\x00", "===", "loweig", " thblouble,"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def fuzzed(n):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return texts + [None, "", " ", "x" * 5000, "= " * 3000, "a  b " * 2000]


def test_encode_matches_library(library):
    texts = fuzzed(1500) + [f"{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    encoder = bpe.BlockEncoder(bpe_vocab.load_vocabulary(PATH), memo_units=500)
    got = [x for i in range(0, len(texts), 700) for x in encoder.encode(pa.array(texts[i:i + 700], pa.string())).to_pylist()]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want


def test_long_run_of_one_symbol(library):
    pairs = bpe.PairRanks(bpe_vocab.load_vocabulary(PATH))
    for text in ("a" * 999, "=" * 1001, "-" * 4097):
        assert list(bpe.merge_pieces([text], pairs)[0]) == library.encode(text, add_special_tokens=False).ids
    assert bpe.merge_pieces([], pairs) == []


def test_shortcut_is_proven(library):
    vocab = bpe_vocab.load_vocabulary(PATH)
    single = token_counts.prove_single_tokens(vocab)
    for s in random.Random(1).sample(sorted(single), 500):
        assert len(library.encode(s, add_special_tokens=False).ids) == 1
    assert "<|endoftext|>" not in single


def test_spark_round_trip(spark, library):
    texts = fuzzed(300)
    rows = [(i if i % 50 else None, t, "kept", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, IDS int").repartition(3)
    got = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH)
    assert "n_tokens" in got.columns and [c.lower() for c in got.columns].count("ids") == 1
    for r in got.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    once = bpe.round_trip(df, PATH)
    assert once.columns == got.columns and once.exceptAll(got).isEmpty() and got.exceptAll(once).isEmpty()
    assert bpe.round_trip(df, PATH, keep_text=False).columns == [c for c in got.columns if c != "text"]
    over = bpe.round_trip(df.select("doc_id", "text"), PATH, decoded="text")  # the source itself is replaced
    assert over.columns == ["doc_id", "ids", "text"]
    assert over.exceptAll(got.select("doc_id", "ids", F.col("decoded").alias("text"))).isEmpty()
    counted = token_counts.token_counts(df, PATH, limit=100).collect()
    assert len(counted) == len(texts)
    for r in counted:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100)


def test_decode_of_odd_ids(spark, library):
    ids = [[101, 50256, 9999], [-1, 60000, 40], [None, 41], None, [], [188, 99, 222]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "n int, ids array<int>")
    got = {r["n"]: r["decoded"] for r in bpe.decode_ids(df, PATH).collect()}
    assert got[3] == got[4] == "" and got[1] == library.decode([40], skip_special_tokens=False)
    assert got[0] == library.decode(ids[0], skip_special_tokens=False)
    assert got[5] == library.decode(ids[5], skip_special_tokens=False)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(df, PATH).count() == 0
    assert token_counts.token_counts(df, PATH).count() == 0


def test_queries_match_library(spark, sf_small, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op10_bpe(spark, sf_small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    for r in queries.op1_token_counts(spark, sf_small).collect():
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)


def test_vocabulary_is_checked(tmp_path):
    bad = tmp_path / "v.json"
    bad.write_text('{"model": {"type": "WordPiece", "vocab": {}}}')
    with pytest.raises(ValueError):
        bpe_vocab.load_vocabulary(str(bad))

"""The registered queries of this package: each runs one operator, with
production parameters, over its whole table."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, exact_dedup, line_dedup, packing, periodic, quality, repeats, simhash, spelling, token_counts,
               toxicity, warc)
from .common import let, once_per_worker, read_table, shared_folder, utf8


def byte_bpe_path() -> str:
    """The vocabulary file the contracts name."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, byte_bpe_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    folder = shared_folder(spark, "warc")
    manifest = warc.write_archives(warc.decide_records(read_table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(manifest, folder, with_payload=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from the rows not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn_lexicon(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of ``documents`` packed into rows of 2,048 and
    written; where each segment lies (the file by the digest of its matrix, the
    row in it, the start), verified against the files."""
    folder = shared_folder(spark, "packed")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    shared = spark.sparkContext.broadcast(ranks)  # bounded: the vocabulary file

    def tokens():
        library = once_per_worker("tiktoken", lambda: tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=shared.value, special_tokens={}))

        def encode(texts: pa.Array) -> pa.ListArray:
            ids = [library.encode_to_numpy(t or "", disallowed_special=()) for t in texts.to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
        return encode

    segments = packing.pack(read_table(spark, sf_dir, "documents"), folder, tokens, pad=50256)
    return packing.verify_packed(segments, folder).drop("path")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` without their source's boilerplate lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, host="source").select("doc_id", "text", "n_lines", "n_dropped")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its best window."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark")).drop("text_md5")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document, and whether it is kept."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    scored = quality.score(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "host_posterior", "path_posterior", "score", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=3, max_bits=3).select("doc_id", "fingerprint", "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every row of ``documents``."""
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids and decoded text of each document, as the contract's digests."""
    decoded = bpe.round_trip(docs.select("doc_id", "text"), byte_bpe_path(), keep_text=False)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document."""
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def misspelt(words: DataFrame) -> DataFrame:
    """``words`` (doc_id, word) with a code point deleted from one in 199, as the contract has it."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return words.withColumn("h", h).select("doc_id", F.when(F.col("h") % 199 == 0, less).otherwise(F.col("word")).alias("word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` that occurs often enough, with the form it is a variant of."""
    words = misspelt(spelling.letter_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=6))
    return spelling.variant_groups(spelling.vocabulary(words, shortest=6, least=5), times=5)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` without passages of 50 words that a smaller doc_id has too."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.drop_repeats(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2(utf8("text"), 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of one in ten made periodic from some word on, as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(words, lambda w, i: F.when(
            i >= v["a"], F.get(words, v["a"] + (i - v["a"]) % v["p"])).otherwise(w)), " "))

    changed = let(repeats.words_of("text"), lambda words: F.when(F.size(words) > 0, repeated(words)))
    return docs.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every text of ``documents``."""
    docs = with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs)
    # Runs come by start, then period: of equal exponents the first one stays.
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("top", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(utf8("collapsed"), 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_toxicity, op4_packing, op5_line_dedup, op6_decontaminate, op7_quality,
                                   op8_simhash, op9_exact_dedup, op10_bpe, op11_spelling, op12_substring_dedup, op13_periodic_runs)}

ORACLE_SQL = {
    "op2_warc": """
        WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
                      FROM pages),
        first AS (SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest),
        decided AS (SELECT r.*, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM rows r LEFT JOIN first f USING (payload_digest))
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM decided""",
    "op5_line_dedup": """
        WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
        once AS (SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: BARE), lambda x: x <> ''))) AS line
                 FROM pages),
        counted AS (SELECT source, line, count(*) AS pages FROM once GROUP BY ALL HAVING count(*) > 1),
        totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
        found AS (SELECT c.source, list(line) AS gone FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
                  WHERE pages > 0.02 * total GROUP BY c.source)
        SELECT doc_id,
               CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(gone, BARE), false)), chr(10)) END AS text,
               CAST(coalesce(len(list_filter(lines, lambda x: BARE <> '')), 0) AS BIGINT) AS n_lines,
               CAST(coalesce(len(list_filter(lines, lambda x: coalesce(list_contains(gone, BARE), false))), 0) AS BIGINT) AS n_dropped
        FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source""".replace("BARE", f"trim(x, '{line_dedup.WHITE}')"),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}

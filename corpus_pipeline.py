"""Clean a corpus and encode what is left, each stage on all its predecessor kept.

Every stage takes any documents: NULL and empty texts, NULL ids, very long texts,
repeated rows, an empty table, and extra columns whatever their names. All but
the last return the columns that they got. What each makes of odd rows is stated
with it; the rest is stated in the operator's module.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.llm import decontaminate, exact_dedup, quality, queries, simhash  # noqa: E402
from ledgerlens.llm.common import read_table, shared_folder  # noqa: E402


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A NULL text is judged as an empty one, a NULL source or language as one of
    its own; repeated rows are judged alike; a score of exactly the threshold stays.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays.

    NULL equals the empty text. A row without id stays only if no equal one has
    an id; of repeated rows one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row with the least id stays.

    Empty texts have fingerprint zero and link like any other. A row without id
    stays only if the component has none; of the same id and text one row stays,
    of the same id and different texts the one with the least SHA-256.
    """
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Empty texts hold none; repeated rows go or stay together. Rows are told
    apart by id (NULL being one) and text.
    """
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each document, as digests.

    NULL and empty texts give no ids. A row for each row, repeated ones too.
    """
    return queries.bpe_digests(docs)


STAGES = [
    ("quality classifier", drop_bad),
    ("exact dedup", drop_exact),
    ("SimHash near-dedup", drop_near),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", encode),
]

#: SimHash needs XXH64 and BPE its merges, which SQL can't express; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet
    in the shared folder and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The scheduled anomaly monitor as an incremental Structured Streaming job.

Each run picks up the monthly revenue files that arrived since the last run
(file source, ``availableNow`` trigger) and publishes only findings that were
not published before (keyed by account, month and anomaly type).

A run doesn't read the history. The detector looks back on a fixed number of
rows, so a state table keeps just these per account: its last rows with their
forward-filled values. Accounts are dealt over buckets, by which state, history
and findings are partitioned; a run reads and rewrites the state of the buckets
its accounts fall into, and nothing of the others. An account that gets a month
not after its last one (late or repeated data), or that has rows without month,
is run again over its own history, read from its bucket.

Exactly-once: every write of a micro-batch goes to a partition named by its
batch id and overwrites it, so a batch replayed after a failure rewrites the
same files (and reads the state from before it); the checkpoint (under
``spark.checkpoint.dir`` unless given) records which files each batch consumed.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.anomaly import DetectorConfig, FINDING_KEY, anomaly_report, anomaly_series, null_safe_anti
from ..session import ensure_checkpoint_dir, materialize
from ..sources.schemas import MONTHLY_SERIES

# Buckets of accounts: a run's state is read and rewritten by whole buckets.
BUCKETS = 64
_STATE = ("account string, tail array<struct<month: date, revenue: double, filled: double>>, undated boolean, "
          "batch_id long, bucket int")
_FINDINGS = ("account string, month string, revenue double, rolling_mean double, pct_vs_baseline double, z_score double, "
             "anomaly_type string, severity_score double, priority string, batch_id long, bucket int")


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # Works on any Hadoop file system: a missing folder is the empty table.
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # a schema or permission error must not re-publish everything
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(path))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("account"), F.lit(buckets)).cast("int")


def latest_state(spark: SparkSession, out_dir: str, buckets: list[int], before: int | None = None) -> DataFrame:
    """The newest state of the given buckets (written by a batch earlier than
    ``before``): account, tail, undated, bucket. Only these partitions are read."""
    state = _read_or_empty(spark, os.path.join(out_dir, "state"), _STATE).filter(F.col("bucket").isin(buckets))
    if before is not None:
        state = state.filter(F.col("batch_id") < before)
    # At most one pair for each bucket asked for.
    newest = state.groupBy("bucket").agg(F.max("batch_id").alias("batch_id")).collect()
    here = F.lit(False)
    for r in newest:
        here = here | ((F.col("bucket") == r["bucket"]) & (F.col("batch_id") == r["batch_id"]))
    return state.filter(here).select("account", "tail", "undated", "bucket")


def _enrich(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    return anomaly_series(rows, cfg, carried="carried", keep=("_filled", "fresh"))


def _process(spark: SparkSession, out_dir: str, cfg: DetectorConfig, buckets: int):
    history_path, state_path, findings_path = (os.path.join(out_dir, x) for x in ("history", "state", "findings"))
    depth = max(cfg.window, cfg.erosion_window)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch.select("account", "month", "revenue").withColumn("bucket", _bucket(buckets)))
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        # 1. append the batch to the history (idempotent per batch id)
        _write(batch, history_path, batch_id)

        # 2. accounts that go on from their state, and those that need their history
        state = latest_state(spark, out_dir, touched, before=batch_id)
        arrived = batch.groupBy("account").agg(
            F.min("month").alias("first"), F.max(F.col("month").isNull()).alias("now_undated"),
            (F.count("month") > F.countDistinct("month")).alias("repeats"))
        known = state.withColumnRenamed("account", "of")
        moved = arrived.join(known, F.col("account").eqNullSafe(F.col("of")), "left")
        late = F.coalesce(F.col("first") <= F.element_at("tail", -1)["month"], F.lit(False))
        moved = materialize(moved.select(
            "account", F.coalesce("tail", F.array().cast("array<struct<month: date, revenue: double, filled: double>>")).alias("tail"),
            (F.col("now_undated") | F.coalesce("undated", F.lit(False))).alias("undated"), (late | F.col("repeats")).alias("late")))
        again = moved.filter("undated OR late").select("account")
        on_time = moved.filter("NOT (undated OR late)")

        none = F.lit(None).cast("double")
        tails = on_time.select("account", F.inline("tail")).select(
            "account", "month", "revenue", F.col("filled").alias("carried"), F.lit(False).alias("fresh"))
        rows = batch.select("account", "month", "revenue", none.alias("carried"), F.lit(True).alias("fresh"))
        rows = null_safe_anti(rows, again, ["account"])
        past = spark.read.parquet(history_path).filter(F.col("bucket").isin(touched))
        whole = null_safe_anti(past, again, ["account"], "left_semi").select(
            "account", "month", "revenue", none.alias("carried"), F.lit(True).alias("fresh"))
        enriched = materialize(_enrich(tails.unionByName(rows).unionByName(whole), cfg))

        # 3. only findings not published by an earlier batch
        report = anomaly_report(enriched.filter("fresh"))
        published = _read_or_empty(spark, findings_path, _FINDINGS).filter(
            F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id)).select(*FINDING_KEY)
        found = null_safe_anti(report, published, FINDING_KEY)
        _write(found.withColumn("bucket", _bucket(buckets)), findings_path, batch_id)

        # 4. the state of the touched buckets, accounts that did not move included
        last = F.slice(F.array_sort(F.collect_list(F.struct("month", "revenue", F.col("_filled").alias("filled")))), -depth, depth)
        size = F.count(F.lit(1))
        tail = enriched.groupBy("account").agg(
            F.when(size >= depth, last).otherwise(F.array_sort(F.collect_list(F.struct("month", "revenue", F.col("_filled").alias("filled"))))).alias("tail"))
        marks = moved.select(F.col("account").alias("of"), "undated")
        new = tail.join(marks, F.col("account").eqNullSafe(F.col("of"))).select("account", "tail", "undated", _bucket(buckets).alias("bucket"))
        still = null_safe_anti(state, moved.select("account"), ["account"])
        _write(new.unionByName(still), state_path, batch_id)

    return handle


def run_monitor(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str | None = None,
                cfg: DetectorConfig = DetectorConfig(), file_format: str = "parquet", buckets: int = BUCKETS) -> None:
    """Process every file that arrived in ``source_dir`` since the last run
    and return when done (one scheduled run). ``buckets`` must stay the same
    for one ``out_dir``."""
    if checkpoint is None:  # monitors that differ in either folder never share one
        name = hashlib.sha256(f"{source_dir}\n{out_dir}".encode()).hexdigest()
        checkpoint = os.path.join(ensure_checkpoint_dir(spark), "monitor", name)
    reader = spark.readStream.schema(MONTHLY_SERIES)
    if file_format == "csv":
        reader = reader.option("header", True)
    stream = reader.format(file_format).load(source_dir)
    query = (
        stream.writeStream.foreachBatch(_process(spark, out_dir, cfg, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def published_findings(spark: SparkSession, out_dir: str) -> DataFrame:
    """All findings published so far (report columns and the batch id)."""
    return _read_or_empty(spark, os.path.join(out_dir, "findings"), _FINDINGS).drop("bucket")

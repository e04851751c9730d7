"""The shared checkpoint folder comes from the session, and materialize()
writes a reliable checkpoint there."""

import os

from ledgerlens.session import bounded_count, ensure_checkpoint_dir, materialize


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == configured


def test_materialize_writes_under_the_shared_folder(spark):
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    df = materialize(spark.range(100).selectExpr("id", "id * 2 AS twice"))
    assert df.count() == 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan or "LogicalRDD" in df._jdf.queryExecution().optimizedPlan().toString()
    after = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    assert after >= before and sc_dir_used(spark)


def sc_dir_used(spark):
    d = spark.sparkContext.getCheckpointDir()
    return d is not None and d.replace("file:", "").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_bounded_count_stops_at_the_limit(spark):
    assert bounded_count(spark.range(10_000), 10) == 11
    assert bounded_count(spark.range(5), 10) == 5

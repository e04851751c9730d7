"""The incremental monitor: each scheduled run publishes only new findings,
a run with no new files publishes nothing, and the union of all runs is the
batch report."""

import datetime as dt
import random
import re
import tempfile

from pyspark.sql import functions as F

from ledgerlens.plans import anomaly as N
from ledgerlens.sources import adapters as A
from ledgerlens.streaming import monitor as MON


def test_monitor_runs_publish_only_new_findings(spark, sf_small):
    base = tempfile.mkdtemp(prefix="ledgerlens-monitor-")
    src, out, ckpt = f"{base}/src", f"{base}/out", f"{base}/ckpt"
    series = A.monthly_revenue_by_nation(spark, sf_small)
    cuts = [dt.date(2000, 1, 1), dt.date(2001, 1, 1), dt.date(2002, 1, 1)]
    lo = dt.date(1900, 1, 1)
    counts = []
    for hi in cuts:
        series.filter((series.month >= lo) & (series.month < hi)).write.mode("append").parquet(src)
        MON.run_monitor(spark, src, out, checkpoint=ckpt)
        counts.append(MON.published_findings(spark, out).count())
        lo = hi
    MON.run_monitor(spark, src, out, checkpoint=ckpt)            # nothing new arrived
    findings = MON.published_findings(spark, out)
    assert findings.count() == counts[-1]
    assert counts == sorted(counts)
    key = ["account", "month", "anomaly_type"]
    assert findings.select(*key).distinct().count() == findings.count()   # nothing published twice
    batch = N.anomaly_report(N.anomaly_series(series)).select(*key)
    assert {tuple(r) for r in findings.select(*key).collect()} == {tuple(r) for r in batch.collect()}


def monthly(rows, spark):
    return spark.createDataFrame([(a, m, None if v is None else float(v)) for a, m, v in rows], "account string, month date, revenue double")


def keys(df):
    return {(r["account"], r["month"], r["anomaly_type"], r["severity_score"], r["z_score"]) for r in df.collect()}


def test_state_runs_equal_the_batch_report(spark):
    """Month by month, with gaps, missing values, short and absent accounts and a NULL account: what all
    runs publish is what the whole series gives."""
    rnd = random.Random(3)
    base = tempfile.mkdtemp(prefix="ledgerlens-state-")
    src, out, ckpt = f"{base}/src", f"{base}/out", f"{base}/ckpt"
    months = [dt.date(2000 + m // 12, m % 12 + 1, 1) for m in range(20)]
    rows = []
    for a in [*(f"a{i}" for i in range(30)), None]:
        level = rnd.randint(50, 500)
        for m in months:
            if rnd.random() < 0.85:
                level *= rnd.choice([1, 1, 1, 1.02, 0.97, 0.6, 1.9])
                rows.append((a, m, rnd.choice([level, level, level, level, None, float("nan")])))
    for part in (months[:7], months[7:8], months[8:9], months[9:15], months[15:]):
        monthly([r for r in rows if r[1] in part], spark).write.mode("append").parquet(src)
        MON.run_monitor(spark, src, out, checkpoint=ckpt, buckets=5)
    want = N.anomaly_report(N.anomaly_series(monthly(rows, spark)))
    assert keys(MON.published_findings(spark, out)) == keys(want) and want.count() > 20
    tails = MON.latest_state(spark, out, list(range(5))).collect()
    assert len(tails) == 31 and max(len(r["tail"]) for r in tails) == 6
    for r in tails:
        own = sorted(m for a, m, _ in rows if a == r["account"])[-6:]
        assert [t["month"] for t in r["tail"]] == own


def test_late_months_run_their_account_again(spark):
    base = tempfile.mkdtemp(prefix="ledgerlens-late-")
    src, out, ckpt = f"{base}/src", f"{base}/out", f"{base}/ckpt"
    month = lambda m: dt.date(2000 + m // 12, m % 12 + 1, 1)
    first = [(a, month(m), 100.0 + m % 3) for a in "xyz" for m in range(10) if (a, m) != ("x", 6)]
    second = [("x", month(6), 900.0), ("y", month(10), 500.0), ("w", None, 5.0)]   # late, on time, undated
    third = [("x", month(10), 40.0), ("w", month(3), 7.0), ("z", month(9), 1.0)]   # after the late one, undated before, repeated
    for part in (first, second, third):
        monthly(part, spark).write.mode("append").parquet(src)
        MON.run_monitor(spark, src, out, checkpoint=ckpt, buckets=3)
    found = MON.published_findings(spark, out)
    whole = N.anomaly_report(N.anomaly_series(monthly([r for r in first + second + third if r[0] in "xyw"], spark)))
    assert keys(whole) <= keys(found)
    assert {("x", "2000-07", "SPIKE"), ("y", "2000-11", "SPIKE")} <= {(r["account"], r["month"], r["anomaly_type"]) for r in found.collect()}


def test_a_run_touches_its_buckets_only(spark):
    base = tempfile.mkdtemp(prefix="ledgerlens-buckets-")
    src, out, ckpt = f"{base}/src", f"{base}/out", f"{base}/ckpt"
    rows = [(f"a{i}", dt.date(2000, 1, 1), 1.0) for i in range(40)]
    monthly(rows, spark).write.mode("append").parquet(src)
    MON.run_monitor(spark, src, out, checkpoint=ckpt, buckets=8)
    monthly([("a7", dt.date(2000, 2, 1), 2.0)], spark).write.mode("append").parquet(src)
    MON.run_monitor(spark, src, out, checkpoint=ckpt, buckets=8)
    written = spark.read.parquet(f"{out}/state").groupBy("batch_id").agg(F.countDistinct("bucket").alias("n")).orderBy("batch_id").collect()
    assert [r["n"] for r in written] == [8, 1]
    state = MON.latest_state(spark, out, list(range(8)))
    assert state.count() == 40 and {len(r["tail"]) for r in state.filter("account = 'a7'").collect()} == {2}
    plan = MON.latest_state(spark, out, [2])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = 2", plan)

"""Bench: wall time of the headline reports on local[$BENCH_CPUS].

Each query runs once to warm up, then ``BENCH_REPEAT`` times (default 3);
the median is reported. A run executes the whole plan into Spark's no-op
sink, so nothing is gathered on the driver. Prints one JSON line.

Also times a one-thread run of the anomaly detector's formulas (R6) on the
same per-customer series, a group at a time, as a control of the machine.

``BENCH_PROFILE=1`` also writes Spark's event log to a fresh scratch folder
and adds, per report, the stage count and shuffle bytes written of the last
timed run (the UI stays off).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "aging_receivables", "payment_shortfall", "duplicate_charges", "contract_variance", "leakage_summary",
    "monthly_exceptions", "anomaly_series", "anomaly_report", "anomaly_report_customer", "metric_flag",
    "multi_metric_pulse", "pattern_tagging_documents", "freight_exception_report", "freight_dashboard",
    "recovery_dashboard", "multi_source_merge", "metric_flag_events", "pattern_tagging_extended",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _one_thread_detector_seconds(spark, sf_dir: str) -> float | None:
    """Control: the detector's formulas on one thread, a group at a time."""
    try:
        import numpy as np
    except ImportError:  # pragma: no cover
        return None
    from ledgerlens.sources import adapters as A

    pdf = A.monthly_revenue_by_customer(spark, sf_dir).toPandas()
    t0 = time.perf_counter()

    def series(values: "np.ndarray") -> tuple:
        n = len(values)
        # Row i of `past` holds the six values before i.
        past = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(6, np.nan), values]), 6)[:n]
        present = np.isfinite(past).sum(axis=1)
        total = np.nansum(past, axis=1)
        mean = np.where(present >= 5, total / np.maximum(present, 1), np.nan)
        spread = np.sqrt(np.nansum((past - mean[:, None]) ** 2, axis=1) / np.maximum(present - 1, 1))
        z = (values - mean) / np.maximum(spread, 0.03 * mean)
        return z, values / past[:, 0] - 1

    with np.errstate(all="ignore"):
        pdf.groupby("account")[["month", "revenue"]].apply(lambda g: series(g.sort_values("month")["revenue"].to_numpy(float)))
    return time.perf_counter() - t0


def _profile(log_dir: str) -> dict[str, dict]:
    """Stages and shuffle bytes per job description from an event log."""
    import glob

    stage_job: dict[int, str] = {}
    per: dict[str, dict] = {}
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                   if os.path.isfile(p) and "appstatus" not in os.path.basename(p))
    for path in paths:
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e["Event"]
                if kind == "SparkListenerJobStart":
                    desc = (e.get("Properties") or {}).get("spark.job.description")
                    if desc:
                        for sid in e.get("Stage IDs", []):
                            stage_job[sid] = desc
                elif kind == "SparkListenerStageCompleted":
                    desc = stage_job.get(e["Stage Info"]["Stage ID"])
                    if desc:
                        per.setdefault(desc, {"stages": 0, "shuffle_bytes": 0})["stages"] += 1
                elif kind == "SparkListenerTaskEnd":
                    desc = stage_job.get(e.get("Stage ID"))
                    metrics = e.get("Task Metrics") or {}
                    written = (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    if desc:
                        per.setdefault(desc, {"stages": 0, "shuffle_bytes": 0})["shuffle_bytes"] += written
    return per


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    profile = os.environ.get("BENCH_PROFILE") == "1"
    from ledgerlens.registry import QUERIES
    from ledgerlens.session import local_session

    log_dir, extra_conf = None, {}
    if profile:
        import tempfile

        log_dir = tempfile.mkdtemp(prefix="ledgerlens-eventlog-")
        extra_conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                      "spark.eventLog.compress": "false"}
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="ledgerlens-bench", extra_conf=extra_conf)
    sc = spark.sparkContext
    timings: dict[str, float] = {}
    for name in HEADLINE:
        q = QUERIES[name]
        _run(q(spark, sf_dir))  # warm-up
        runs = []
        for i in range(repeat):
            sc.setJobDescription(f"{name}#{i}")
            t0 = time.perf_counter()
            _run(q(spark, sf_dir))
            runs.append(time.perf_counter() - t0)
            sc.setJobDescription(None)
        timings[name] = round(statistics.median(runs), 3)
    control = _one_thread_detector_seconds(spark, sf_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    spark.stop()
    extra = {}
    if log_dir:
        per = _profile(log_dir)
        extra["profile_last_run"] = {n: per.get(f"{n}#{repeat - 1}", {}) for n in HEADLINE}
    print(json.dumps({
        "metric": "sum of median wall time of headline reports",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
        "control_one_thread_r6_customer_sec": None if control is None else round(control, 3),
        **extra,
    }))


if __name__ == "__main__":
    main()

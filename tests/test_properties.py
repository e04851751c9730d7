"""Properties: partition-count invariance, R1 bucket arithmetic, R7 size,
and the detector against pandas on many random series with NULL runs and
flat stretches."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.plans import anomaly as N
from ledgerlens.plans import billing as B
from ledgerlens.sources import adapters as A
from ledgerlens.sources.schemas import MONTHLY_SERIES


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results_do_not_depend_on_shuffle_partitions(spark, sf_small):
    b = A.billing(spark, sf_small)
    series = A.monthly_revenue_by_customer(spark, sf_small)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append((
                _rows(B.aging_receivables(b.invoices, b.accounts, A.AS_OF)),
                _rows(B.duplicate_charges(b.invoices, b.accounts)),
                _rows(N.anomaly_report(N.anomaly_series(series))),
            ))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_buckets_plus_not_yet_due_is_the_total(spark, sf_small):
    b = A.billing(spark, sf_small)
    inv = b.invoices.filter(F.col("due_date").isNotNull())
    r1 = B.aging_receivables(inv, b.accounts, A.AS_OF).collect()
    days = F.datediff(F.lit(A.AS_OF), F.col("due_date"))
    not_due = (inv.filter(~F.col("status").isin("paid", "void", "written_off") & (F.col("amount_due") > 0)
                          & (days <= 0))
               .join(b.accounts, "account_id").agg(F.sum("amount_due")).collect()[0][0] or 0)
    buckets = sum(r["bucket_1_30"] + r["bucket_31_60"] + r["bucket_61_90"] + r["bucket_90_plus"] for r in r1)
    assert buckets + not_due == sum(r["total_outstanding"] for r in r1)


def test_report_size_is_the_non_normal_rows(spark, sf_small):
    enriched = N.anomaly_series(A.monthly_revenue_by_customer(spark, sf_small))
    assert N.anomaly_report(enriched).count() == enriched.filter(F.col("anomaly_type") != "NORMAL").count()


def _pandas_pad(pdf):
    out = []
    for _, g in pdf.sort_values(["account", "month"]).groupby("account", sort=False):
        g = g.copy()
        r = g["revenue"].rolling(6, min_periods=5)
        g["rolling_mean"] = r.mean().shift(1)
        g["rolling_std"] = r.std().shift(1).clip(lower=g["rolling_mean"] * 0.03)
        g["z_score"] = ((g["revenue"] - g["rolling_mean"]) / g["rolling_std"]).replace([np.inf, -np.inf], np.nan)
        filled = g["revenue"].ffill()
        g["erosion_pct"] = (filled / filled.shift(6) - 1).replace([np.inf, -np.inf], np.nan)
        point = g["z_score"].abs() >= 2.5
        g["anomaly_type"] = np.where(point & (g["z_score"] > 0), "SPIKE",
                                     np.where(point & (g["z_score"] < 0), "DROP",
                                              np.where(g["erosion_pct"] <= -0.30, "EROSION", "NORMAL")))
        out.append(g)
    return pd.concat(out)


def test_detector_matches_pandas_on_random_series(spark):
    rng = np.random.default_rng(11)
    rows = []
    for a in range(300):
        n = int(rng.integers(0, 40))
        level = float(rng.uniform(10, 1000))
        vals = level * (1 + rng.normal(0, float(rng.choice([0.0, 0.01, 0.2, 0.6])), n))
        vals = np.abs(vals) + 1.0
        if n and rng.random() < 0.5:                   # NULL runs
            start = int(rng.integers(0, n))
            vals[start:start + int(rng.integers(1, 8))] = np.nan
        if n > 8 and rng.random() < 0.3:               # a step down (erosion) or a spike
            k = int(rng.integers(6, n))
            vals[k:] *= float(rng.choice([0.3, 0.6, 2.5]))
        base = dt.date(2015, 1, 1)
        for i, v in enumerate(vals):
            month = dt.date(base.year + (base.month - 1 + i) // 12, (base.month - 1 + i) % 12 + 1, 1)
            rows.append((f"a{a:03d}", month, None if np.isnan(v) else float(v)))
    df = spark.createDataFrame(rows, MONTHLY_SERIES)
    pdf = pd.DataFrame(rows, columns=["account", "month", "revenue"]).astype({"revenue": float})
    expected = _pandas_pad(pdf).set_index(["account", "month"]).sort_index()
    got = N.anomaly_series(df).toPandas().set_index(["account", "month"]).sort_index()
    assert list(got.index) == list(expected.index)
    for col in ("rolling_mean", "rolling_std", "z_score", "erosion_pct"):
        a, b = got[col].astype(float).to_numpy(), expected[col].astype(float).to_numpy()
        assert np.array_equal(np.isnan(a), np.isnan(b)), col
        ok = ~np.isnan(a)
        assert np.allclose(a[ok], b[ok], rtol=1e-9, atol=1e-9), col
    assert (got["anomaly_type"] == expected["anomaly_type"]).all()

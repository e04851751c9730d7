"""Per-key rolling-baseline anomaly detection over monthly series.

For each key (account) and each row in period order: mean and sample std of
the previous ``window`` rows (at least ``min_periods`` present), the std
floored at a share of the mean, a z-score and a percentage against the
baseline, a point test on |z|, an erosion test on the change against the
value ``erosion_window`` rows earlier, a type (SPIKE / DROP / EROSION /
NORMAL) and a severity that puts both tests on one scale.

Plan: one hash exchange on the key, one sort, and all window columns
computed by Window operators sharing that partitioning and order; no Python
worker. Labels are CASE expressions inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    anomaly_type, month_label, priority_tier, round_half_even, severity_score,
)
from ..operators.windows import (
    forward_filled, forward_filled_split, lagged_pct_change, ordered_window, split_series, trailing_stats,
)


@dataclass(frozen=True)
class DetectorConfig:
    # Fixed values of the source detector.
    window: int = 6               # trailing rows in the baseline
    z_threshold: float = 2.5      # |z| at or above this is a point anomaly
    erosion_window: int = 6       # rows back for the erosion change
    erosion_threshold: float = -0.30  # change at or below this is erosion
    min_periods: int = 5          # present rows needed for a baseline
    std_floor: float = 0.03       # std floored at this share of the mean
    fill: str = "pad"             # erosion change over forward-filled values ("pad") or raw ("none")


REPORT_COLUMNS = ("account", "month", "revenue", "rolling_mean", "pct_vs_baseline", "z_score",
                  "anomaly_type", "severity_score")


def nan_as_null(df: DataFrame, column: str):
    """``column`` with NaN, which counts as missing, as NULL."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if df.schema[column].dataType.typeName() in ("double", "float") else c


def anomaly_series(series: DataFrame, cfg: DetectorConfig = DetectorConfig(),
                   key: str = "account", order: str = "month", value: str = "revenue",
                   split_rows: int | None = None, carried: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Enriched series: one output row per input row with the baseline,
    z-score, flags, type and severity (R6).

    ``carried`` names a column with filled values known from earlier rows
    that aren't in ``series`` any more; ``keep`` lists columns to pass on
    (``_filled``, the filled value, can be among them).

    ``split_rows`` (optional) evaluates the windows on blocks of that many
    rows per key with a halo of the rows they look back on (see
    ``split_series``), so a key with a very long series is spread over many
    tasks; the result is the same.
    """
    passed = [c for c in dict.fromkeys([*keep, *([carried] if carried else [])]) if c != "_filled"]
    series = series.select(key, order, nan_as_null(series, value).alias(value), *passed)
    if carried:
        series = series.withColumn("_known", F.coalesce(F.col(value), F.col(carried)))
    known = "_known" if carried else value
    if split_rows:
        work = split_series(series, [key], order,
                            halo=max(cfg.window, cfg.erosion_window), block_rows=split_rows)
        keys, pos = [key, "_block"], order
    else:
        work, keys, pos = series, [key], order
    stats = trailing_stats(value, keys, pos, cfg.window, cfg.min_periods)
    if cfg.fill == "pad":
        work = forward_filled_split(work, known, [key], order) if split_rows else work.withColumn(
            "_filled", forward_filled(known, keys, pos))
    else:
        work = work.withColumn("_filled", F.col(value))
    base = work.withColumn("rolling_mean", stats["mean"]).withColumn("_std", stats["std"])
    change_of = "_filled" if cfg.fill == "pad" else value
    mean = F.col("rolling_mean")
    floor = mean * cfg.std_floor
    std = F.when(F.col("_std").isNotNull(), F.greatest(F.col("_std"), floor))
    rev = F.col(value)
    enriched = (
        base.withColumn("rolling_std", std)
        .withColumn("z_score", (rev - mean) / F.nullif(F.col("rolling_std"), F.lit(0.0)))
        .withColumn("pct_vs_baseline", (rev - mean) / F.nullif(mean, F.lit(0.0)) * 100)
        .withColumn("point_anomaly", F.coalesce(F.abs(F.col("z_score")) >= cfg.z_threshold, F.lit(False)))
        .withColumn("erosion_pct", lagged_pct_change(change_of, keys, pos, cfg.erosion_window))
        .withColumn("erosion_flag", F.coalesce(F.col("erosion_pct") <= cfg.erosion_threshold, F.lit(False)))
    )
    typed = enriched.withColumn(
        "anomaly_type", anomaly_type(F.col("point_anomaly"), F.col("z_score"), F.col("erosion_flag")))
    out = typed.withColumn(
        "severity_score", severity_score(F.col("anomaly_type"), F.col("erosion_pct"), F.col("z_score")))
    if split_rows:
        out = out.filter(~F.col("_halo"))
    return out.select(key, order, value, "rolling_mean", "rolling_std", "z_score", "pct_vs_baseline",
                      "point_anomaly", "erosion_pct", "erosion_flag", "anomaly_type", "severity_score", *keep)


def anomaly_report(enriched: DataFrame, key: str = "account", order: str = "month",
                   value: str = "revenue") -> DataFrame:
    """Non-NORMAL rows ranked by the unrounded severity, month as ``yyyy-MM``,
    values rounded like pandas (ties to even), and a priority tier taken from
    the rounded severity (R7)."""
    return report_rows(enriched, key, order, value).orderBy(F.desc("_raw_severity"), "account", "month").drop("_raw_severity")


def report_rows(enriched: DataFrame, key: str = "account", order: str = "month", value: str = "revenue") -> DataFrame:
    """The rows of the report in no order, with the unrounded ``_raw_severity``."""
    flagged = enriched.filter(F.col("anomaly_type") != "NORMAL")
    rounded = flagged.select(
        F.col(key).alias("account"),
        month_label(order).alias("month"),
        round_half_even(F.col(value), 2).alias("revenue"),
        round_half_even(F.col("rolling_mean"), 2).alias("rolling_mean"),
        round_half_even(F.col("pct_vs_baseline"), 1).alias("pct_vs_baseline"),
        round_half_even(F.col("z_score"), 2).alias("z_score"),
        "anomaly_type",
        round_half_even(F.col("severity_score"), 2).alias("severity_score"),
        F.col("severity_score").alias("_raw_severity"),
    )
    return rounded.withColumn("priority", priority_tier(F.col("severity_score"), F.col("anomaly_type")))


def top_report_rows(report: DataFrame, n: int = 15) -> DataFrame:
    """First ``n`` rows of the ranked report (a top-k: TakeOrderedAndProject)."""
    return report.limit(n)


# ---------------------------------------------------------------- summaries

def summary_by_type(report: DataFrame) -> DataFrame:
    """Per anomaly type: rows, mean of the rounded severity (rounded to 2),
    distinct accounts."""
    return report.groupBy("anomaly_type").agg(
        F.count("account").alias("count"),
        round_half_even(F.avg("severity_score"), 2).alias("avg_severity"),
        F.countDistinct("account").alias("accounts_affected"),
    )


PRIORITIES = ("HIGH", "MEDIUM", "LOW")


def priority_counts(report: DataFrame) -> DataFrame:
    """Rows per priority on a fixed HIGH / MEDIUM / LOW spine, missing → 0.
    The spine is three literal rows; the counts are one grouped aggregate."""
    spark = report.sparkSession
    spine = spark.createDataFrame([(p, i) for i, p in enumerate(PRIORITIES)], "priority string, rank int")
    counts = report.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return (
        F.broadcast(spine).join(counts, "priority", "left")
        .select("priority", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count"), "rank")
        .orderBy("rank").drop("rank")
    )


def headline(series: DataFrame, report: DataFrame, key: str = "account", order: str = "month") -> DataFrame:
    """Accounts and months analysed (input series), anomalies flagged and
    accounts with a HIGH priority finding, in one row.

    The series and the report are aggregated separately (the report side has
    a single distinct count, so no Expand); the two one-row results are
    stacked and folded with ``max`` — no join.
    """
    none = F.lit(None).cast("long")
    inputs = series.agg(
        F.countDistinct(key).alias("accounts_analyzed"), F.countDistinct(order).alias("months_analyzed"),
    ).select("accounts_analyzed", "months_analyzed",
             none.alias("anomalies_flagged"), none.alias("high_priority_accounts"))
    found = report.agg(
        F.count(F.lit(1)).alias("anomalies_flagged"),
        F.countDistinct(F.when(F.col("priority") == "HIGH", F.col("account"))).alias("high_priority_accounts"),
    ).select(none.alias("accounts_analyzed"), none.alias("months_analyzed"),
             "anomalies_flagged", "high_priority_accounts")
    both = inputs.unionByName(found)
    return both.agg(*[F.max(c).alias(c) for c in
                      ("accounts_analyzed", "months_analyzed", "anomalies_flagged", "high_priority_accounts")])


# ---------------------------------------------------------------- chart feed

def top_accounts(enriched: DataFrame, n: int = 4, key: str = "account") -> DataFrame:
    """The ``n`` accounts with the worst single anomaly (unrounded severity
    of non-NORMAL rows, ties by account): per-account maximum with partial
    aggregation, then a top-n."""
    return (
        enriched.filter(F.col("anomaly_type") != "NORMAL")
        .groupBy(key).agg(F.max("severity_score").alias("worst"))
        .orderBy(F.desc("worst"), key).limit(n)
    )


def chart_feed(enriched: DataFrame, n: int = 4, key: str = "account",
               order: str = "month", value: str = "revenue") -> DataFrame:
    """Series, baseline and flagged points of the top ``n`` accounts — the
    data behind the four-panel chart (drawing is not built). The chosen
    accounts (at most ``n`` rows, a proven bound) are broadcast into a semi
    join."""
    chosen = F.broadcast(top_accounts(enriched, n, key).select(key))
    return enriched.join(chosen, key, "left_semi").select(
        key, order, value, "rolling_mean", "anomaly_type",
        (F.col("anomaly_type") != "NORMAL").alias("flagged"),
    )


# ---------------------------------------------------------------- generic flag

# Rows of a block of a series without a key.
KEYLESS_ROWS = 100_000


def strict_baseline(df: DataFrame, metric: str, keys: Sequence[str], order: str, window: int = 6,
                    split_rows: int | None = None) -> DataFrame:
    """Adds ``baseline`` and ``spread``: mean and sample std of the previous
    ``window`` rows, only when all ``window`` rows are present (W10). Of equal
    values they are that value and 0, without the rounding of a sum.
    ``split_rows`` spreads longer series over blocks (``split_series``); a
    single series without a key is split by default, 0 turns that off."""
    df = df.withColumn(metric, nan_as_null(df, metric))
    split_rows = KEYLESS_ROWS if split_rows is None and not keys else split_rows
    if split_rows:
        work = split_series(df, list(keys), order, halo=window, block_rows=split_rows)
        st = trailing_stats(metric, [*keys, "_block"], order, window, window)
        mean, std = _exact_if_flat(st)
        out = work.withColumn("baseline", mean).withColumn("spread", std).filter(~F.col("_halo"))
        return out.drop("_block", "_halo")
    st = trailing_stats(metric, keys, order, window, window)
    mean, std = _exact_if_flat(st)
    return df.withColumn("baseline", mean).withColumn("spread", std)


def _exact_if_flat(st: dict) -> tuple:
    flat = st["min"] == st["max"]
    return (F.when(flat & st["mean"].isNotNull(), st["min"]).otherwise(st["mean"]),
            F.when(flat & st["std"].isNotNull(), F.lit(0.0)).otherwise(st["std"]))


def _abs_z_at_least(x, base, spread, z: float):
    # |x − base| / spread >= z with IEEE semantics: spread 0 and x ≠ base is an
    # infinite z (flagged); spread 0 and x = base is NaN (not flagged). The
    # baseline of a flat window is its value itself, so "equal" is exact.
    return (
        F.when(spread > 0, F.abs(x - base) / spread >= z)
        .when(spread == 0, x != base)
        .otherwise(F.lit(False))
    )


def metric_flag(df: DataFrame, metric: str, keys: Sequence[str] = (), order: str = "month",
                window: int = 6, z: float = 2.5, split_rows: int | None = None) -> DataFrame:
    """Rows whose ``metric`` lies ``z`` or more sample stds from the mean of
    the previous ``window`` rows of the same key (full window required, no
    floor). Returns the offending input rows (U2)."""
    b = strict_baseline(df, metric, keys, order, window, split_rows)
    hit = F.coalesce(_abs_z_at_least(F.col(metric), F.col("baseline"), F.col("spread"), z), F.lit(False))
    return b.filter(hit).select(*df.columns)


def floored_baseline_flag(df: DataFrame, metric: str, keys: Sequence[str] = (), order: str = "month",
                          window: int = 6, z: float = 2.5, floor: float = 0.03,
                          split_rows: int | None = None) -> DataFrame:
    """Full-window baseline with the spread floored at ``floor`` × baseline,
    then ``|z| >= z`` (W11). Returns the offending rows with baseline and z."""
    b = strict_baseline(df, metric, keys, order, window, split_rows)
    spread = F.when(F.col("spread").isNotNull(), F.greatest(F.col("spread"), F.col("baseline") * floor))
    hit = F.coalesce(_abs_z_at_least(F.col(metric), F.col("baseline"), spread, z), F.lit(False))
    zcol = (F.col(metric) - F.col("baseline")) / F.nullif(spread, F.lit(0.0))
    return b.filter(hit).select(*df.columns, "baseline", zcol.alias("z"))


def multi_metric_pulse(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (), order: str = "month",
                       window: int = 6, z: float = 2.5, split_rows: int | None = None) -> DataFrame:
    """``metric_flag`` for several metrics in one pass: unpivot to
    (metric, value) and partition by key and metric, so one exchange serves
    every metric (U3). Output: keys, order, metric, value."""
    long = df.unpivot([*keys, order], list(metrics), "metric", "value")
    flagged = metric_flag(long, "value", [*keys, "metric"], order, window, z, split_rows)
    return flagged.select(*keys, order, "metric", "value")


# ---------------------------------------------------------------- new findings

FINDING_KEY = ("account", "month", "anomaly_type")


def new_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings of the current report that the previous report did not have,
    keyed by (account, month, anomaly type). NULL keys are equal to one another."""
    return null_safe_anti(current, previous.select(*FINDING_KEY), FINDING_KEY)


def null_safe_anti(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left_anti") -> DataFrame:
    """Rows of ``left`` without (``left_semi``: with) equal keys in ``right``, NULL keys being equal."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(other, same, how)


# ---------------------------------------------------------------- one run, all outputs

@dataclass(frozen=True)
class DetectorRun:
    enriched: DataFrame
    report: DataFrame
    top_rows: DataFrame
    by_type: DataFrame
    by_priority: DataFrame
    headline: DataFrame
    chart_feed: DataFrame


def run_detector(series: DataFrame, cfg: DetectorConfig = DetectorConfig(), key: str = "account",
                 order: str = "month", value: str = "revenue", split_rows: int | None = None,
                 checkpoint: bool = True) -> DetectorRun:
    """All outputs of one detector run over ``series``: enriched series,
    ranked report, its first 15 rows, summaries by type and priority, the
    headline and the chart feed of the top 4 accounts.

    With ``checkpoint`` the enriched series is written once to the shared
    checkpoint folder (reliable checkpoint), so the outputs read it instead of
    re-running the windows, and a lost executor does not reach back to the
    sources.
    """
    from ..session import materialize

    enriched = anomaly_series(series, cfg, key, order, value, split_rows)
    if checkpoint:
        enriched = materialize(enriched)
    report = anomaly_report(enriched, key, order, value)
    return DetectorRun(
        enriched=enriched,
        report=report,
        top_rows=top_report_rows(report, 15),
        by_type=summary_by_type(report),
        by_priority=priority_counts(report),
        headline=headline(series, report, key, order),
        chart_feed=chart_feed(enriched, 4, key, order, value),
    )


ANOMALY_TYPES = ("SPIKE", "DROP", "EROSION")


def summary_table(enriched: DataFrame, key: str = "account", order: str = "month") -> DataFrame:
    """All of R8 in one long table (section, label, metric, value): the
    summary by type, the priority counts and the headline, from one pass over
    the enriched series (one detector run, nothing sorted, no distinct count).

    One grouping-sets aggregate makes a row per account, with its counts by
    type and priority, and a row per month; these add up to every figure. The
    types and priorities are fixed, so they are columns until the end.
    """
    flagged = F.col("anomaly_type") != "NORMAL"
    severity = round_half_even(F.col("severity_score"), 2)
    rows = enriched.select(
        F.col(key).alias("account"), F.col(order).alias("month"), F.when(flagged, F.col("anomaly_type")).alias("type"),
        F.when(flagged, severity).alias("severity"), F.when(flagged, priority_tier(severity, F.col("anomaly_type"))).alias("priority"))
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    parts = rows.groupingSets([[F.col("account")], [F.col("month")]], "account", "month").agg(
        F.grouping("account").alias("of_month"), count_if(F.col("type").isNotNull()).alias("flagged"),
        *[count_if(F.col("type") == t).alias(f"n_{t}") for t in ANOMALY_TYPES],
        *[F.sum(F.when(F.col("type") == t, F.col("severity"))).alias(f"s_{t}") for t in ANOMALY_TYPES],
        *[count_if(F.col("priority") == p).alias(f"n_{p}") for p in PRIORITIES])
    own, known = F.col("of_month") == 0, F.col("account").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(own, c)), F.lit(0))
    how_many = lambda c: F.coalesce(count_if(c), F.lit(0)).cast("double")
    wide = parts.agg(
        *[F.struct(total(F.col(f"n_{t}")).alias("any"), total(F.when(known, F.col(f"n_{t}")).otherwise(0)).cast("double").alias("count"),
                   round_half_even(F.sum(F.when(own, F.col(f"s_{t}"))) / F.nullif(total(F.col(f"n_{t}")), F.lit(0)), 2).alias("avg_severity"),
                   how_many(own & known & (F.col(f"n_{t}") > 0)).alias("accounts_affected")).alias(t) for t in ANOMALY_TYPES],
        *[total(F.col(f"n_{p}")).cast("double").alias(p) for p in PRIORITIES],
        how_many(own & known).alias("accounts_analyzed"),
        how_many(~own & F.col("month").isNotNull()).alias("months_analyzed"),
        total(F.col("flagged")).cast("double").alias("anomalies_flagged"),
        how_many(own & known & (F.col("n_HIGH") > 0)).alias("high_priority_accounts"))
    figure = lambda section, label, metric, value: F.struct(
        F.lit(section).alias("section"), F.lit(label).cast("string").alias("label"), F.lit(metric).alias("metric"), value.alias("value"))
    by_type = [F.when(F.col(f"{t}.any") > 0, F.array(*[figure("by_type", t, m, F.col(f"{t}.{m}"))
                                                       for m in ("count", "avg_severity", "accounts_affected")])) for t in ANOMALY_TYPES]
    rest = F.array(*[figure("by_priority", p, "count", F.col(p)) for p in PRIORITIES],
                   *[figure("headline", None, m, F.col(m)) for m in
                     ("accounts_analyzed", "months_analyzed", "anomalies_flagged", "high_priority_accounts")])
    return wide.select(F.inline(F.flatten(F.array_compact(F.array(*by_type, rest)))))

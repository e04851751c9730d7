"""Pre-audit vs post-audit recovery model: per month the error pool, what
the pre-audit caught (avoided), what the post-audit recovered, true leakage,
catch rate and the cost multiple of the post-audit channel; a full-year row;
the same per error type, with costs from a table of rates; a month × error
type matrix; and the months whose catch rate breaks from the trailing norm.

The source gives these as prose and published figures only (28 %
contingency fee, 6.5× cost multiple); the formulas are ours.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.anomaly import metric_flag

# Fixed values from the source prose: the contingency fee of the post-audit
# channel and the published cost multiple (post vs pre per dollar).
CONTINGENCY_FEE = 0.28
COST_MULTIPLE = 6.5


def _ratio(num, den):
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def recovery_dashboard(lines: DataFrame, contingency: float = CONTINGENCY_FEE,
                       pre_cost_rate: float = CONTINGENCY_FEE / COST_MULTIPLE) -> DataFrame:
    """One row per month plus a full-year (``FY``) row via ROLLUP.

    pool = value of all errors; avoided = caught pre-audit; recovered =
    post-audit; leakage = pool − avoided − recovered; catch_rate =
    avoided / pool; post_cost = contingency × recovered; pre_cost =
    pre_cost_rate × avoided; cost_multiple = (post_cost / recovered) /
    (pre_cost / avoided).
    """
    amt = F.col("amount")
    ch = F.col("channel")
    # Aggregate per month first (partial aggregation over the lines), then
    # roll the monthly rows up: the ROLLUP expands a few rows, not every line.
    monthly = lines.groupBy("month").agg(
        F.sum(amt).alias("_pool"),
        F.sum(F.when(ch == "PRE", amt).otherwise(F.lit(0))).alias("_avoided"),
        F.sum(F.when(ch == "POST", amt).otherwise(F.lit(0))).alias("_recovered"),
        F.count(F.lit(1)).alias("_errors"),
    )
    rolled = monthly.rollup("month").agg(
        F.sum("_pool").alias("pool"),
        F.sum("_avoided").alias("avoided"),
        F.sum("_recovered").alias("recovered"),
        F.sum("_errors").cast("long").alias("errors"),
        F.grouping("month").alias("_fy"),
    )
    post_cost = F.col("recovered").cast("double") * contingency
    pre_cost = F.col("avoided").cast("double") * pre_cost_rate
    return rolled.select(
        F.when(F.col("_fy") == 1, F.lit("FY")).otherwise(F.date_format("month", "yyyy-MM")).alias("period"),
        "errors", "pool", "avoided", "recovered",
        (F.col("pool") - F.col("avoided") - F.col("recovered")).alias("leakage"),
        _ratio(F.col("avoided"), F.col("pool")).alias("catch_rate"),
        post_cost.alias("post_cost"),
        pre_cost.alias("pre_cost"),
        (_ratio(post_cost, F.col("recovered")) / F.nullif(_ratio(pre_cost, F.col("avoided")), F.lit(0.0)))
        .alias("cost_multiple"),
    )


ALL_TYPES = "ALL"


def recovery_by_type(lines: DataFrame, costs: DataFrame, default_pre: float | None = None,
                     default_post: float | None = None) -> DataFrame:
    """R15 as a cube of month × error type: pool, avoided, recovered, leakage,
    catch rate, channel costs and cost multiple of every (month, type), of each
    month over all types, of each type over the full year (``FY``), and of all.

    ``costs`` (month, channel, rate) says what a unit recovered through a
    channel (``PRE``, ``POST``) cost in a month; rows for one month and channel
    add up. Costs are exact decimals (rates of six digits). A month without a rate takes the default; without one its cost, and
    that of every total it is part of, is NULL. ``level`` tells the rows apart
    (GROUPING_ID: 0 month and type, 1 month, 2 type, 3 total). NULL months and
    types are groups of their own, shown as NULL.

    The lines are aggregated per (month, type) before the rates are joined and
    the cube is taken, so neither the join nor the cube sees a line.
    """
    amt, ch = F.col("amount"), F.col("channel")
    cells = lines.groupBy("month", "error_type").agg(
        F.sum(amt).alias("_pool"),
        F.sum(F.when(ch == "PRE", amt).otherwise(F.lit(0))).alias("_avoided"),
        F.sum(F.when(ch == "POST", amt).otherwise(F.lit(0))).alias("_recovered"),
        F.count(F.lit(1)).alias("_errors"),
    )
    rate = lambda c: F.sum(F.when(F.col("channel") == c, F.col("rate"))).cast("decimal(8,6)")
    cost = lambda of, at, default: F.col(of).cast("decimal(28,4)") * F.coalesce(at, F.lit(default).cast("decimal(8,6)"))
    rates = costs.groupBy(F.col("month").alias("_cm")).agg(rate("PRE").alias("_pre_rate"), rate("POST").alias("_post_rate"))
    priced = (
        cells.join(rates, F.col("month").eqNullSafe(F.col("_cm")), "left")
        .withColumn("_pre", cost("_avoided", "_pre_rate", default_pre))
        .withColumn("_post", cost("_recovered", "_post_rate", default_post))
    )
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    cube = priced.cube("month", "error_type").agg(
        F.sum("_pool").alias("pool"), F.sum("_avoided").alias("avoided"), F.sum("_recovered").alias("recovered"),
        F.sum("_errors").cast("long").alias("errors"), whole("_pre").alias("pre_cost"), whole("_post").alias("post_cost"),
        F.grouping("month").alias("_fy"), F.grouping("error_type").alias("_all"),
    )
    return cube.select(
        (F.col("_fy") * 2 + F.col("_all")).cast("long").alias("level"),
        F.when(F.col("_fy") == 1, F.lit("FY")).otherwise(F.date_format("month", "yyyy-MM")).alias("period"),
        F.when(F.col("_all") == 1, F.lit(ALL_TYPES)).otherwise(F.col("error_type")).alias("error_type"),
        "errors", "pool", "avoided", "recovered",
        (F.col("pool") - F.col("avoided") - F.col("recovered")).alias("leakage"),
        _ratio(F.col("avoided"), F.col("pool")).alias("catch_rate"),
        "pre_cost", "post_cost",
        (_ratio(F.col("post_cost"), F.col("recovered")) / F.nullif(_ratio(F.col("pre_cost"), F.col("avoided")), F.lit(0.0)))
        .alias("cost_multiple"),
    )


OTHER = "other"


def error_month_matrix(lines: DataFrame, error_types: Sequence[str] | None = None, most: int = 50) -> DataFrame:
    """Month × error type matrix of the error pool. Types that aren't named,
    and NULL, are summed in the column ``other``, so a row adds up to the
    month's pool whatever the types are.

    Without ``error_types`` the columns are found: the ``most`` first types by
    name, one bounded distinct count when the plan is built.
    """
    if error_types is None:
        found = lines.select("error_type").filter(F.col("error_type").isNotNull()).distinct().orderBy("error_type").limit(most)
        error_types = [r["error_type"] for r in found.collect()]  # at most `most`
    named = [t for t in error_types if t != OTHER]
    kind = F.when(F.col("error_type").isin(named), F.col("error_type")).otherwise(F.lit(OTHER))
    return lines.select("month", kind.alias("_kind"), "amount").groupBy("month").pivot("_kind", [*named, OTHER]).agg(F.sum("amount"))


def catch_rate_flags(dashboard: DataFrame, window: int = 6, z: float = 2.5) -> DataFrame:
    """Months whose catch rate lies ``z`` stds from the previous ``window``
    months (R16). One series ordered by month: the window has no key, which
    is fine because the input is already one row per month."""
    months = dashboard.filter(F.col("period") != "FY").select("period", "catch_rate", "pool")
    return metric_flag(months, "catch_rate", [], "period", window, z, split_rows=0)

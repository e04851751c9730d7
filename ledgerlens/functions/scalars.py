"""Scalar column expressions shared by the reports.

All are built-in Spark expressions (JVM side, inside whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: dt.date | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def days_past_due(as_of: dt.date | Column, due: Column | str) -> Column:
    """``as_of - due`` as an integer day count (negative when not yet due).
    Spark's ``date - date`` is an interval, so use ``datediff``."""
    return F.datediff(as_of_col(as_of), F.col(due) if isinstance(due, str) else due)


def as_of_col(as_of: dt.date | Column) -> Column:
    return as_date(as_of)


def year_start(as_of: dt.date | Column) -> Column:
    """First day of the year of ``as_of`` as a DATE (``date_trunc`` would give a timestamp)."""
    return F.trunc(as_of_col(as_of), "year")


def plus_days(as_of: dt.date | Column, days: int) -> Column:
    return F.date_add(as_of_col(as_of), days)


def safe_div(num: Column, den: Column) -> Column:
    """``num / nullif(den, 0)``: a zero denominator gives NULL, not an error."""
    return num / F.nullif(den, F.lit(0))


def share_exceeds(part: Column, whole: Column, cut: str) -> Column:
    """``part / whole > cut`` for decimals, by multiplying, so a share of just
    ``cut`` doesn't exceed it. NULL for a zero ``whole``."""
    bound = F.lit(Decimal(cut)) * whole
    return F.when(whole > 0, part > bound).when(whole < 0, part < bound)


def percent_of(part: Column, whole: Column, digits: int) -> Column:
    """``part`` of ``whole`` (money, two decimals) in percent, rounded half up
    (away from zero) from the exact quotient. NULL for a zero ``whole``."""
    part, whole = part.cast("decimal(30,2)"), whole.cast("decimal(30,2)")
    n, d = F.abs(part), F.abs(whole)
    twice = F.lit(Decimal(2 * 100 * 10 ** digits))
    units = F.call_function("div", twice * n + d, F.lit(Decimal(2)) * F.nullif(d, F.lit(Decimal(0))))
    return F.when((part < 0) != (whole < 0), -units).otherwise(units) / F.lit(float(10 ** digits))


def month_label(c: Column | str) -> Column:
    """``yyyy-MM`` label of a date."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM")


def round_half_even(c: Column, digits: int) -> Column:
    """pandas / numpy rounding of a double: ``rint(x · 10^d) / 10^d`` (ties to
    even on the scaled binary value, so 9.995 → 9.99 and 0.125 → 0.12).

    Spark's ``bround(x, d)`` rounds the shortest decimal string of ``x``
    instead (9.995 → 10.0). At zero digits the two agree, because a scaled
    double is an exact tie exactly when its shortest string ends in ``.5``.
    """
    scale = float(10 ** digits)
    return F.bround(c.cast("double") * F.lit(scale), 0) / F.lit(scale)


def round_half_up(c: Column, digits: int) -> Column:
    """SQL ``ROUND(double, d)`` as C's ``round(x · 10^d) / 10^d`` (ties away
    from zero on the scaled binary value; 1.005 → 1.0)."""
    scale = float(10 ** digits)
    return F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale)


def lower_contains(text: Column, needle: str) -> Column:
    """Case-insensitive substring test against a literal."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


# --------------------------------------------------------------------------
# Billing labels
# --------------------------------------------------------------------------
# The labels and cuts of this and the next section (10,000 and
# 5,000; 5 %; 90 days; 40 / 20 and 10 / 4) are the reports' own.

def collection_priority(over_90: Column, over_60: Column) -> Column:
    """ESCALATE above 10 000 past 90 days; else PRIORITY FOLLOW-UP above 5 000
    past 60 days (the 60-day sum includes the >90 amounts); else STANDARD."""
    return (
        F.when(over_90 > 10000, "ESCALATE")
        .when(over_60 > 5000, "PRIORITY FOLLOW-UP")
        .otherwise("STANDARD")
    )


def billing_status(actual: Column, contracted: Column) -> Column:
    """Ordered CASE of the contract reconciliation. A NULL ``actual`` (no
    billing) fails every test and falls through to IN LINE, as in the source."""
    return (
        F.when(share_exceeds(F.abs(actual - contracted), contracted, "0.05"), "REVIEW REQUIRED")
        .when(actual > contracted, "OVER-BILLED")
        .when(actual < contracted, "UNDER-BILLED")
        .otherwise("IN LINE")
    )


def renewal_flag(contract_end: Column, auto_renew: Column, as_of: dt.date | Column, horizon_days: int = 90) -> Column:
    """RENEWAL RISK when the contract ends within the horizon and does not
    auto-renew; NULL otherwise (a NULL ``auto_renew`` is not a risk)."""
    return F.when((contract_end <= plus_days(as_of, horizon_days)) & (auto_renew == F.lit(False)), "RENEWAL RISK")


# --------------------------------------------------------------------------
# Anomaly labels
# --------------------------------------------------------------------------

def anomaly_type(point_anomaly: Column, z: Column, erosion_flag: Column) -> Column:
    """SPIKE / DROP when the point test fires (sign of z), else EROSION when
    the trend test fires, else NORMAL. Flags are never NULL (NULL → false)."""
    point = F.coalesce(point_anomaly, F.lit(False))
    return (
        F.when(point & (z > 0), "SPIKE")
        .when(point & (z < 0), "DROP")
        .when(F.coalesce(erosion_flag, F.lit(False)), "EROSION")
        .otherwise("NORMAL")
    )


def severity_score(atype: Column, erosion_pct: Column, z: Column) -> Column:
    """EROSION: |erosion| × 100; other types: |z|, NULL z → 0."""
    return F.when(atype == "EROSION", F.abs(erosion_pct) * 100).otherwise(F.coalesce(F.abs(z), F.lit(0.0)))


def priority_tier(score: Column, atype: Column) -> Column:
    """HIGH / MEDIUM / LOW; EROSION cuts at 40 / 20, point types at 10 / 4.
    Applied to the rounded score."""
    return (
        F.when(atype == "EROSION",
               F.when(score >= 40, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW"))
        .otherwise(F.when(score >= 10, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW"))
    )


# --------------------------------------------------------------------------
# Freight labels (definitions are ours; the source describes them in prose)
# --------------------------------------------------------------------------

def within_tolerance(billed: Column, expected: Column, kind: Column, tolerance: Column) -> Column:
    """Whether a charge is off by at most the allowance, a flat dollar amount
    or a share of the expected charge (a NULL allowance is not within)."""
    allowance = F.when(kind == "flat", tolerance).otherwise(expected * tolerance)
    return F.coalesce(F.abs(billed - expected) <= allowance, F.lit(False))


def is_overcharge(rate: Column, billed: Column, expected: Column, kind: Column, tolerance: Column) -> Column:
    """A rate, a charge above it, and not within tolerance."""
    return rate.isNotNull() & (billed > expected) & ~within_tolerance(billed, expected, kind, tolerance)


def tolerance_class(rate: Column, billed: Column, expected: Column, kind: Column, tolerance: Column) -> Column:
    """RATE NOT ON FILE / WITHIN TOLERANCE / OVERCHARGE / UNDERBILL."""
    return (
        F.when(rate.isNull(), "RATE NOT ON FILE")
        .when(within_tolerance(billed, expected, kind, tolerance), "WITHIN TOLERANCE")
        .when(is_overcharge(rate, billed, expected, kind, tolerance), "OVERCHARGE")
        .otherwise("UNDERBILL")
    )


def demurrage(arrived: Column, delivered: Column, free_days: Column, day_rate: Column) -> Column:
    """Days beyond the free-day allowance times the daily rate, never negative."""
    return F.greatest(F.datediff(delivered, arrived) - free_days, F.lit(0)) * day_rate


def shortpay_reason(balance: Column, paid: Column, label: Column) -> Column:
    """SHORT PAY when something was paid but less than approved, BALANCE DUE
    when nothing was paid; the reason code carries the tolerance label."""
    return (
        F.when((balance > 0) & (paid > 0), F.concat(F.lit("SHORT PAY: "), label))
        .when(balance > 0, F.concat(F.lit("BALANCE DUE: "), label))
    )

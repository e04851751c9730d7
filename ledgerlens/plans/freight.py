"""Freight invoice audit: rate lookup, tolerance classification, demurrage,
short-pay detection, the exception report and the dashboard aggregates.

The source describes these only in prose; the definitions below are ours:
rate = contracted rate for (carrier, lane, container), else the spot quote, else
"rate not on file"; expected = rate × qty; the account's tolerance is a flat
dollar amount or a share of expected; demurrage = days beyond the free-day
allowance × daily rate; approved = expected for an overcharge, else billed;
balance = approved − paid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import demurrage, is_overcharge, shortpay_reason, tolerance_class
from ..session import broadcast_lookup

RATE_KEY = ("carrier", "lane", "container")
# Lookup tables up to this many rows are broadcast (a few tens of MB).
LOOKUP_BROADCAST_ROWS = 1_000_000


def first_rate(rates: DataFrame, alias: str) -> DataFrame:
    """One rate per (carrier, lane, container): the row with the lowest ordinal
    (a lookup returns the first match). Grouped ``min_by`` with partial
    aggregation, so a key listed many times is combined map-side."""
    return rates.groupBy(*RATE_KEY).agg(F.min_by("rate", F.struct("ordinal", "rate")).alias(alias))


def audit_lines(invoices: DataFrame, contract_rates: DataFrame, spot_quotes: DataFrame,
                rules: DataFrame) -> DataFrame:
    """Every freight line with rate, source, expected charge, tolerance label,
    demurrage, approved amount, balance and pay status.

    Rate tables (one row per key after ``first_rate``) and rules are keyed
    lookups. Each is broadcast where its files are small or a bounded count
    proves it has at most ``LOOKUP_BROADCAST_ROWS`` rows; a larger one is left to
    AQE (runtime size check, shuffle join beyond it).
    """
    contract = broadcast_lookup(first_rate(contract_rates, "contract_rate"), LOOKUP_BROADCAST_ROWS)
    spot = broadcast_lookup(first_rate(spot_quotes, "spot_rate"), LOOKUP_BROADCAST_ROWS)
    joined = (
        invoices.join(contract, list(RATE_KEY), "left")
        .join(spot, list(RATE_KEY), "left")
        .join(broadcast_lookup(rules, LOOKUP_BROADCAST_ROWS), "account_id", "left")
    )
    rate = F.coalesce(F.col("contract_rate"), F.col("spot_rate"))
    expected = (rate * F.col("qty")).cast("decimal(18,2)")
    lines = joined.select(
        *invoices.columns,
        rate.alias("rate"),
        F.when(F.col("contract_rate").isNotNull(), "CONTRACT")
        .when(F.col("spot_rate").isNotNull(), "SPOT").otherwise("NONE").alias("rate_source"),
        expected.alias("expected"),
        "kind", "tolerance", "free_days", "day_rate",
    )
    label = tolerance_class(F.col("rate"), F.col("billed"), F.col("expected"), F.col("kind"), F.col("tolerance"))
    labelled = lines.withColumn("audit_label", label).withColumn(
        "demurrage",
        F.coalesce(demurrage(F.col("arrived"), F.col("delivered"), F.col("free_days"), F.col("day_rate")),
                   F.lit(0)).cast("decimal(18,2)"),
    )
    over = is_overcharge(F.col("rate"), F.col("billed"), F.col("expected"), F.col("kind"), F.col("tolerance"))
    approved = F.when(over, F.col("expected")).otherwise(F.col("billed"))
    return (
        labelled.withColumn("approved", approved)
        .withColumn("balance", F.col("approved") - F.col("paid"))
        .withColumn("pay_status", shortpay_reason(F.col("balance"), F.col("paid"), F.col("audit_label")))
        .drop("kind", "tolerance", "free_days", "day_rate")
    )


def is_exception() -> F.Column:
    """Not within tolerance, or an open balance (the lines with a pay status).
    Written on ``balance`` rather than on the pay-status text, so a filter
    pushed below the projections does not carry the label expression again."""
    return (F.col("audit_label") != "WITHIN TOLERANCE") | (F.col("balance") > 0)


def exception_report(lines: DataFrame) -> DataFrame:
    """Overcharges, underbills, rate-not-on-file and short/unpaid lines."""
    return lines.filter(is_exception()).select(
        "invoice_id", "line_no", "account_id", "carrier", "lane", "mode", "container", "rate_source",
        "billed", "expected", "paid", "balance", "demurrage", "audit_label", "pay_status",
    )


def dashboard(lines: DataFrame) -> DataFrame:
    """KPIs by total, carrier, (mode, container) and account in one pass with
    GROUPING SETS (R14): lines, exceptions, exception rate, billed, the sum of
    overcharges above expected, demurrage.

    The lines are first aggregated at the finest grain (carrier, mode,
    container, account; partial aggregation), and the grouping sets then
    expand those few rows instead of every line: counts and sums add up, so
    the result is the same.
    """
    over = F.when(F.col("audit_label") == "OVERCHARGE", F.col("billed") - F.col("expected")).otherwise(F.lit(0))
    dims = ["carrier", "mode", "container", "account_id"]
    fine = lines.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.sum(is_exception().cast("int")).alias("_exc"),
        F.sum("billed").alias("_billed"),
        F.sum(over).alias("_over"),
        F.sum("demurrage").alias("_dem"),
    )
    g = fine.groupingSets([[], ["carrier"], ["mode", "container"], ["account_id"]], *dims).agg(
        F.sum("_lines").cast("long").alias("lines"),
        F.sum("_exc").cast("long").alias("exceptions"),
        F.sum("_billed").alias("billed_total"),
        F.sum("_over").alias("overcharge_total"),
        F.sum("_dem").alias("demurrage_total"),
        F.grouping_id().alias("_gid"),
    )
    level = (
        F.when(F.col("_gid") == 15, "TOTAL")
        .when(F.col("_gid") == 7, "CARRIER")
        .when(F.col("_gid") == 9, "MODE_CONTAINER")
        .otherwise("ACCOUNT")
    )
    return g.select(
        level.alias("level"), "carrier", "mode", "container", "account_id", "lines", "exceptions",
        (F.round(F.col("exceptions") / F.col("lines") * 1e6, 0) / 1e6).alias("exception_rate"),
        "billed_total", "overcharge_total", "demurrage_total",
    )

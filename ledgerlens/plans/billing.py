"""Billing audit reports over invoices, payments, credits, contracts and
accounts: aging receivables, payment shortfall, duplicate charges, contract
variance, the executive leakage summary, and the two short report snippets
(monthly exceptions, >90-day count).

Every report takes an explicit ``as_of`` date in place of CURRENT_DATE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    as_of_col, billing_status, collection_priority, days_past_due, percent_of, renewal_flag, share_exceeds, year_start,
)
from ..sources.schemas import MONEY
from ..operators.relational import (
    count_when, left_join_preaggregated, null_safe_join, per_key_totals, status_live, status_open, sum_when,
    union_all,
)
from ..operators.sequence import numbered_within
from ..operators.skew import HOT_ROWS, hot_keys, salted_left_join

ACCOUNT_ATTRS = ("account_name", "tier", "region", "csm_owner")
FINGERPRINT = ("account_id", "product_line", "billing_period_start", "billing_period_end")


# --------------------------------------------------------------------------
# R1 aging receivables
# --------------------------------------------------------------------------

def aging_receivables(invoices: DataFrame, accounts: DataFrame, as_of: dt.date) -> DataFrame:
    """Open invoices with a positive amount, bucketed by days past due and
    grouped by the four account attributes (accounts sharing all four merge).

    Plan: aggregate invoices per ``account_id`` first (partial aggregation, so
    the shuffle carries one row per account and map task), join the accounts,
    then combine per attribute group. Counts and sums add up and maxima take
    the maximum, so the result equals grouping the joined invoice rows, also
    when an ``account_id`` appears twice in accounts.
    """
    days = days_past_due(as_of, F.col("due_date"))
    amt = F.col("amount_due")
    per_account = (
        invoices.filter(status_open() & (amt > 0))
        .groupBy("account_id")
        .agg(
            F.count("invoice_id").alias("n"),
            F.sum(amt).alias("total"),
            sum_when(days.between(1, 30), amt).alias("b1"),
            sum_when(days.between(31, 60), amt).alias("b2"),
            sum_when(days.between(61, 90), amt).alias("b3"),
            sum_when(days > 90, amt).alias("b4"),
            sum_when(days > 60, amt).alias("over60"),
            F.max(days).alias("max_days"),
        )
    )
    grouped = (
        per_account.join(accounts.select("account_id", *ACCOUNT_ATTRS), "account_id")
        .groupBy(*ACCOUNT_ATTRS)
        .agg(
            F.sum("n").alias("open_invoice_count"),
            F.sum("total").alias("total_outstanding"),
            F.sum("b1").alias("bucket_1_30"),
            F.sum("b2").alias("bucket_31_60"),
            F.sum("b3").alias("bucket_61_90"),
            F.sum("b4").alias("bucket_90_plus"),
            F.sum("over60").alias("over60"),
            F.max("max_days").alias("max_days_outstanding"),
        )
        .filter(F.col("total_outstanding") > 0)
    )
    return grouped.select(
        *ACCOUNT_ATTRS,
        "open_invoice_count", "total_outstanding",
        "bucket_1_30", "bucket_31_60", "bucket_61_90", "bucket_90_plus",
        collection_priority(F.col("bucket_90_plus"), F.col("over60")).alias("collection_priority"),
        "max_days_outstanding",
    ).orderBy(F.desc_nulls_last("total_outstanding"), *ACCOUNT_ATTRS)


# --------------------------------------------------------------------------
# R2 payment shortfall
# --------------------------------------------------------------------------

def payment_totals(payments: DataFrame) -> DataFrame:
    """Per invoice: total paid, number of payments, last payment date."""
    return per_key_totals(
        payments, "invoice_id",
        total_paid=F.sum("amount_paid"),
        payment_count=F.count(F.lit(1)),
        last_payment_date=F.max("payment_date"),
    )


def credit_totals(credit_memos: DataFrame) -> DataFrame:
    return per_key_totals(credit_memos, "invoice_id", total_credits=F.sum("memo_amount"))


def invoice_totals(invoices: DataFrame) -> DataFrame:
    """Live invoices with the columns the shortfall report needs."""
    return invoices.filter(status_live()).select(
        "invoice_id", "account_id", "amount_due", "invoice_date", "due_date", "product_line")


def balance_gaps(invoices: DataFrame, payments: DataFrame, credit_memos: DataFrame) -> DataFrame:
    """Live invoices ⟕ per-invoice payments ⟕ per-invoice credits, kept when
    ``amount − paid − credits > 0.01`` (P6)."""
    paid = F.coalesce(F.col("total_paid"), F.lit(0))
    credits = F.coalesce(F.col("total_credits"), F.lit(0))
    return (
        invoice_totals(invoices)
        .join(payment_totals(payments), "invoice_id", "left")
        .join(credit_totals(credit_memos), "invoice_id", "left")
        .filter(F.col("amount_due") - paid - credits > 0.01)
    )


def payment_shortfall(invoices: DataFrame, payments: DataFrame, credit_memos: DataFrame,
                      accounts: DataFrame, as_of: dt.date) -> DataFrame:
    """Live invoices whose amount exceeds payments plus credits by > 0.01.

    Plan: payments and credits are aggregated per invoice first (one row per
    invoice, partial aggregation). When those aggregates are small AQE
    broadcasts them and the invoices are not shuffled at all; when they are
    large both joins are sort-merge joins on ``invoice_id`` over one exchange
    of the invoices. The gap filter runs before the accounts join, which then
    moves only invoices with a gap.
    """
    paid = F.coalesce(F.col("total_paid"), F.lit(0))
    credits = F.coalesce(F.col("total_credits"), F.lit(0))
    net = F.col("amount_due") - paid - credits
    gaps = balance_gaps(invoices, payments, credit_memos)
    return (
        gaps.join(accounts.select("account_id", "account_name", "tier"), "account_id")
        .select(
            "account_name", "tier", "invoice_id", "invoice_date", "due_date", "product_line", "amount_due",
            paid.alias("total_paid"),
            credits.alias("credits_applied"),
            net.alias("net_balance_due"),
            percent_of(paid, F.col("amount_due"), 2).alias("pct_paid"),
            F.coalesce(F.col("payment_count"), F.lit(0)).alias("payment_count"),
            "last_payment_date",
            days_past_due(as_of, F.col("due_date")).alias("days_past_due"),
        )
        .orderBy(F.desc_nulls_last("net_balance_due"), "invoice_id")
    )


# --------------------------------------------------------------------------
# R3 duplicate charges
# --------------------------------------------------------------------------

def fingerprint_counts(invoices: DataFrame) -> DataFrame:
    """Live invoices per fingerprint (account, product line, period start and
    end; NULL keys form one group), as a grouped count: partial aggregation
    combines a hot fingerprint map-side, unlike a window over its partition."""
    return invoices.filter(status_live()).groupBy(*FINGERPRINT).agg(F.count(F.lit(1)).alias("period_invoice_count"))


def duplicate_invoice_lines(invoices: DataFrame) -> DataFrame:
    """Live invoices whose fingerprint occurs more than once, one row each,
    with the fingerprint's count (the window column of the source query)."""
    live = invoices.filter(status_live()).select("invoice_id", *FINGERPRINT, "amount_due", "invoice_date")
    dups = fingerprint_counts(invoices).filter(F.col("period_invoice_count") > 1)
    return null_safe_join(live, dups, FINGERPRINT)


# Width of the invoice-id ranges in which a group's id list is built before
# the ranges are concatenated (see duplicate_charges).
ID_CHUNK = 1 << 16


def duplicate_charges(invoices: DataFrame, accounts: DataFrame, id_chunk: int = ID_CHUNK) -> DataFrame:
    """One row per duplicated fingerprint (grouped by account name and tier):
    total billed, expected charge (smallest invoice), overcharge and the
    invoice ids in id order.

    The id list is part of the report, so a group's list is as long as the
    group. To keep a hot group from being listed and sorted in one task, the
    list is built in two levels: first per (group, id range) — sums, minima
    and an ordered partial list, spread over many tasks — then the few
    range pieces of each group are ordered by range and joined. Everything
    before is skew-safe (grouped count, null-safe equi-join that AQE splits).
    """
    group = ["account_name", "tier", "product_line", "billing_period_start", "billing_period_end",
             "period_invoice_count"]
    lines = duplicate_invoice_lines(invoices)
    pieces = (
        lines.join(accounts.select("account_id", "account_name", "tier"), "account_id")
        .withColumn("_range", F.floor(F.col("invoice_id") / id_chunk))
        .groupBy(*group, "_range")
        .agg(
            F.sum("amount_due").alias("_sum"),
            F.min("amount_due").alias("_min"),
            F.expr("listagg(CAST(invoice_id AS STRING), ', ') WITHIN GROUP (ORDER BY invoice_id)").alias("_ids"),
        )
    )
    ordered_ids = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("_range", "_ids"))), lambda x: x["_ids"]), ", ")
    return (
        pieces.groupBy(*group)
        .agg(
            F.sum("_sum").alias("total_billed"),
            F.min("_min").alias("expected_charge"),
            ordered_ids.alias("invoice_ids"),
        )
        .withColumn("overcharge_amount", F.col("total_billed") - F.col("expected_charge"))
        .withColumnRenamed("period_invoice_count", "duplicate_count")
        .select("account_name", "tier", "product_line", "billing_period_start", "billing_period_end",
                "duplicate_count", "total_billed", "expected_charge", "overcharge_amount", "invoice_ids")
        .orderBy(F.desc_nulls_last("overcharge_amount"), "account_name", "product_line", "billing_period_start")
    )


# Ids in one page of a list.
PAGE_IDS = 1_000


def duplicate_id_pages(invoices: DataFrame, page_ids: int = PAGE_IDS) -> DataFrame:
    """The id lists of R3 in pages: per duplicated fingerprint and page number
    (from 0), ``n_ids`` and the ids in order, at most ``page_ids`` of them.

    The place of an id in its group comes from range partitioning (see
    ``numbered_within``), so no task and no cell grows with a group.
    """
    lines = duplicate_invoice_lines(invoices).select(*FINGERPRINT, "invoice_id")
    placed = numbered_within(lines, FINGERPRINT, "invoice_id")
    return (
        placed.groupBy(*FINGERPRINT, F.floor((F.col("_idx") - 1) / page_ids).cast("long").alias("page"))
        .agg(F.count(F.lit(1)).alias("n_ids"),
             F.expr("listagg(CAST(invoice_id AS STRING), ', ') WITHIN GROUP (ORDER BY invoice_id)").alias("invoice_ids"))
    )


# --------------------------------------------------------------------------
# R4 contract vs billed
# --------------------------------------------------------------------------

def ytd_billing(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Per account: live billing since 1 January of the as-of year (no upper
    bound) and the number of distinct billing periods."""
    return (
        invoices.filter((F.col("invoice_date") >= year_start(as_of)) & status_live())
        .groupBy("account_id")
        .agg(F.sum("amount_due").alias("actual_arr_billed"),
             F.countDistinct("billing_period_start").alias("periods_billed"))
    )


def contract_variance(contracts: DataFrame, invoices: DataFrame, accounts: DataFrame, as_of: dt.date) -> DataFrame:
    """Active contracts (ending on or after as_of) against year-to-date
    billing: variance, variance %, billing status and renewal risk.

    A contract without billing keeps NULL variance and falls through to
    IN LINE. Several contracts of one account each see the account's whole
    billing.
    """
    actual = F.col("actual_arr_billed")
    arr = F.col("contracted_arr")
    active = contracts.filter(F.col("contract_end") >= as_of_col(as_of))
    joined = (
        active.join(accounts.select("account_id", "account_name", "tier", "region"), "account_id")
        .join(ytd_billing(invoices, as_of), "account_id", "left")
    )
    return (
        joined.select(
            "account_name", "tier", "region", "contracted_arr", "billing_frequency", "contract_start",
            "contract_end", "actual_arr_billed", "periods_billed",
            (actual - arr).alias("arr_variance"),
            percent_of(actual - arr, arr, 2).alias("variance_pct"),
            billing_status(actual, arr).alias("billing_status"),
            renewal_flag(F.col("contract_end"), F.col("auto_renew"), as_of).alias("renewal_flag"),
            F.abs(actual - F.coalesce(arr, F.lit(0))).alias("_order"),
            "contract_id",
        )
        .orderBy(F.desc_nulls_last("_order"), "contract_id")
        .drop("_order", "contract_id")
    )


# --------------------------------------------------------------------------
# R5 leakage summary
# --------------------------------------------------------------------------

def _vector(df: DataFrame, label: str, description: str, count: F.Column, amount: F.Column) -> DataFrame:
    return df.agg(count.cast("long").alias("record_count"), amount.alias("amount_at_risk")).select(
        F.lit(label).alias("leakage_type"), "record_count",
        F.col("amount_at_risk").cast("decimal(38,2)").alias("amount_at_risk"),
        F.lit(description).alias("description"))


def partial_payments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Live invoices with some payment but less than the amount."""
    paid = F.coalesce(F.col("total_paid"), F.lit(0))
    return (
        left_join_preaggregated(invoices.select("invoice_id", "amount_due", "status"), payments, "invoice_id",
                                total_paid=F.sum("amount_paid"))
        .filter(status_live() & (paid > 0) & (paid < F.col("amount_due")))
    )


def duplicate_groups(invoices: DataFrame) -> DataFrame:
    """Fingerprints with more than one live invoice and their overcharge
    (sum − min), grouped by account id (orphans count) (A4, A9)."""
    amt = F.col("amount_due")
    return (
        invoices.filter(status_live()).groupBy(*FINGERPRINT)
        .agg(F.count(F.lit(1)).alias("n"), (F.sum(amt) - F.min(amt)).alias("overcharge_amount"))
        .filter(F.col("n") > 1)
    )


def contract_billing(contracts: DataFrame, invoices: DataFrame, as_of: dt.date) -> DataFrame:
    """Per active contract: live billing of its account since 1 January,
    0 when none (J5, A12).

    The outer join's ON holds the date and status predicates; they restrict
    the invoice side only, so that side is filtered first and aggregated per
    account before the join (contracts × invoices would fan out per account).
    """
    billed_per_account = (
        invoices.filter((F.col("invoice_date") >= year_start(as_of)) & status_live())
        .groupBy("account_id").agg(F.sum("amount_due").alias("account_billed"))
    )
    return (
        contracts.filter(F.col("contract_end") >= as_of_col(as_of))
        .join(billed_per_account, "account_id", "left")
        .groupBy("contract_id", "contracted_arr")
        .agg(F.coalesce(F.sum("account_billed"), F.lit(0)).alias("actual_billed"))
    )


def variance_ratio_exceeds(per_contract: DataFrame, threshold: str = "0.02") -> DataFrame:
    """Contracts whose |billed − ARR| / ARR exceeds ``threshold``."""
    gap = F.abs(F.col("actual_billed") - F.col("contracted_arr"))
    return per_contract.filter(share_exceeds(gap, F.col("contracted_arr"), threshold))


def leakage_vectors(invoices: DataFrame, payments: DataFrame, contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """The four one-row leakage vectors (before share of total)."""
    # The names and descriptions of the vectors are the report's own.
    amt = F.col("amount_due")
    aging = _vector(
        invoices.filter(status_open() & (as_of_col(as_of) > F.col("due_date"))),
        "Aging Receivables", "Invoice unpaid past due date",
        F.countDistinct("invoice_id"), F.sum(amt))

    paid = F.coalesce(F.col("total_paid"), F.lit(0))
    short = _vector(
        partial_payments(invoices, payments),
        "Short Payments", "Invoice partially paid — balance outstanding",
        F.countDistinct("invoice_id"), F.sum(amt - paid))

    dups = _vector(duplicate_groups(invoices), "Duplicate Charges", "Same account billed twice for same period",
                   F.count(F.lit(1)), F.sum("overcharge_amount"))

    gap = F.abs(F.col("actual_billed") - F.col("contracted_arr"))
    variance = _vector(
        variance_ratio_exceeds(contract_billing(contracts, invoices, as_of)),
        "Contract vs Billed Variance", "Billing rate differs from signed contract",
        F.count(F.lit(1)), F.sum(gap))
    return union_all([aging, short, dups, variance])


def leakage_summary(invoices: DataFrame, payments: DataFrame, contracts: DataFrame, as_of: dt.date) -> DataFrame:
    """Four rows, one per leakage vector, with the share of total risk.

    The share window runs over four rows (one partition is harmless here).
    The total is an exact decimal sum; a zero total gives a NULL share.
    """
    vectors = leakage_vectors(invoices, payments, contracts, as_of)
    whole = "_total_at_risk"
    return (
        vectors.withColumn(whole, F.sum("amount_at_risk").over(Window.partitionBy())).select(
            "leakage_type", "record_count",
            F.round("amount_at_risk", 2).alias("amount_at_risk"),
            "description",
            percent_of(F.col("amount_at_risk"), F.col(whole), 1).alias("pct_of_total_risk"),
        )
        .orderBy(F.desc_nulls_last("amount_at_risk"), "leakage_type")
    )


# --------------------------------------------------------------------------
# Snippet reports
# --------------------------------------------------------------------------

def invoice_payment_rows(invoices: DataFrame, payments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``invoices ⟕ payments USING (invoice_id)``: one row per payment, and
    one row with a NULL payment for an invoice without any.

    One left join. An invoice with at least ``hot_rows`` payments (measured
    by a sketch when the plan is built) is spread over salts, so it doesn't
    land in one task; see ``operators/skew.py``.
    """
    pay = payments.select("payment_id", "invoice_id", "amount_paid")
    inv = invoices.select("invoice_id", "account_id", "amount_due")
    return salted_left_join(inv, pay, "invoice_id", hot_keys(pay, "invoice_id", hot_rows), ["payment_id"])


def monthly_exceptions(invoices: DataFrame, payments: DataFrame, accounts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Invoice ⟕ payment rows (one per payment, not aggregated) with
    ``net_balance = amount_due − paid`` above 0.01, largest first."""
    net = F.col("amount_due") - F.coalesce(F.col("amount_paid"), F.lit(0))
    return (
        invoice_payment_rows(invoices, payments, hot_rows)
        .withColumn("net_balance", net)
        .filter(F.col("net_balance") > 0.01)
        .join(accounts.select("account_id", "account_name"), "account_id")
        .select("account_name", "invoice_id", "net_balance")
        .orderBy(F.desc("net_balance"), "invoice_id")
    )


def aging_bucket_count(invoices: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Number of invoices more than ``days`` days late (``d90``)."""
    late = days_past_due(as_of, F.col("due_date"))
    return invoices.agg(count_when(late > days).cast("long").alias("d90"))


def billing_reports(invoices: DataFrame, payments: DataFrame, credit_memos: DataFrame, contracts: DataFrame,
                    accounts: DataFrame, as_of: dt.date) -> dict[str, DataFrame]:
    """The five reports of the billing query set, by name, for one as-of date."""
    return {
        "aging_receivables": aging_receivables(invoices, accounts, as_of),
        "payment_shortfall": payment_shortfall(invoices, payments, credit_memos, accounts, as_of),
        "duplicate_charges": duplicate_charges(invoices, accounts),
        "contract_variance": contract_variance(contracts, invoices, accounts, as_of),
        "leakage_summary": leakage_summary(invoices, payments, contracts, as_of),
    }

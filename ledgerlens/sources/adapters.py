"""Adapters from the driver's TPC-H-like tables to the tables the reports use.

The reference ships no data, so billing, series, freight and recovery inputs
are derived from ``/root/testdata``. Adapters only shape rows into the
expected schema; the reports never rely on how the rows were made and run on
any data of that schema. The same derivations exist as SQL text in
``ledgerlens.oracle`` for the DuckDB comparison.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .schemas import MONEY
from .tables import read_table, session_plan

# Fixed as-of date of every registered report (replaces CURRENT_DATE so runs
# are reproducible). Order dates in the test data run 1995-01-01..2001-08-01.
AS_OF = dt.date(2001, 6, 30)

# Error types of the recovery model (names are ours; the source gives only a count of six).
ERROR_TYPES = (
    "rate_error", "duplicate_billing", "accessorial", "weight_class", "fuel_surcharge", "address_correction",
)


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _date(c: Column) -> Column:
    return F.to_date(c)


# --------------------------------------------------------------------------
# Billing
# --------------------------------------------------------------------------

def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation ⋈ region; tier = market segment, owner = nation."""
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("account_name"),
            F.col("c_mktsegment").alias("tier"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("csm_owner"),
        )
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order, due 30 days after the order date.

    Status rule: key % 211 = 5 → NULL; key % 20 = 0 → void; = 1 → written_off;
    ordered before 2001-02-01 and key % 11 <> 2 → paid; order status P →
    partial; else open. A few rows carry a NULL due date, a NULL period, a
    zero or a negative amount, so the NULL rules of the reports are exercised.
    """
    o = read_table(spark, sf_dir, "orders",
                   "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    d = _date(F.col("o_orderdate"))
    status = (
        F.when(k % 211 == 5, F.lit(None).cast("string"))
        .when(k % 20 == 0, F.lit("void"))
        .when(k % 20 == 1, F.lit("written_off"))
        .when((d < F.lit(dt.date(2001, 2, 1))) & (k % 11 != 2), F.lit("paid"))
        .when(F.col("o_orderstatus") == "P", F.lit("partial"))
        .otherwise(F.lit("open"))
    )
    amount = (
        F.when(k % 401 == 13, F.lit(0).cast(MONEY))
        .when(k % 409 == 17, -_money(F.col("o_totalprice")))
        .otherwise(_money(F.col("o_totalprice")))
    )
    return o.select(
        k.alias("invoice_id"),
        F.col("o_custkey").alias("account_id"),
        d.alias("invoice_date"),
        F.when(k % 307 == 11, F.lit(None).cast("date")).otherwise(F.date_add(d, 30)).alias("due_date"),
        amount.alias("amount_due"),
        status.alias("status"),
        F.when(k % 503 == 19, F.lit(None).cast("date")).otherwise(F.trunc(d, "month")).alias("billing_period_start"),
        F.last_day(d).alias("billing_period_end"),
        F.col("o_orderpriority").alias("product_line"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items not returned are payments against their order's invoice."""
    li = read_table(spark, sf_dir, "lineitem",
                    "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    return li.filter(F.col("l_returnflag") != "R").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("payment_id"),
        F.col("l_orderkey").alias("invoice_id"),
        _date(F.col("l_shipdate")).alias("payment_date"),
        _money(F.col("l_extendedprice")).alias("amount_paid"),
        F.when(F.col("l_linestatus") == "F", "wire").otherwise("card").alias("payment_method"),
    )


def credit_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items become credit memos worth price × discount."""
    li = read_table(spark, sf_dir, "lineitem",
                    "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    amount = (_money(F.col("l_extendedprice")) * F.col("l_discount").cast("decimal(4,2)")).cast(MONEY)
    return li.filter(F.col("l_returnflag") == "R").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("memo_id"),
        F.col("l_orderkey").alias("invoice_id"),
        _date(F.col("l_shipdate")).alias("memo_date"),
        amount.alias("memo_amount"),
        F.lit("RETURN").alias("reason_code"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per customer, a second one for key % 97 = 5.

    ARR = 0 when key % 50 = 7, else |acctbal| × 20. The end date spreads from
    50 days before to 349 days after AS_OF, so some contracts have expired,
    one class ends exactly on AS_OF and one exactly on AS_OF + 90.
    """
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    arr = F.when(k % 50 == 7, F.lit(0).cast(MONEY)).otherwise((F.abs(_money(F.col("c_acctbal"))) * 20).cast(MONEY))
    freq = F.when(k % 3 == 0, "annual").when(k % 3 == 1, "quarterly").otherwise("monthly")
    first = c.select(
        (k * 2).alias("contract_id"),
        k.alias("account_id"),
        arr.alias("contracted_arr"),
        freq.alias("billing_frequency"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), (k % 365).cast("int")).alias("contract_start"),
        F.date_add(F.lit(AS_OF), (k % 400 - 50).cast("int")).alias("contract_end"),
        (k % 3 == 0).alias("auto_renew"),
    )
    second = c.filter(k % 97 == 5).select(
        (k * 2 + 1).alias("contract_id"),
        k.alias("account_id"),
        (F.abs(_money(F.col("c_acctbal"))) * 3).cast(MONEY).alias("contracted_arr"),
        F.lit("monthly").alias("billing_frequency"),
        F.lit(dt.date(2001, 1, 1)).alias("contract_start"),
        F.date_add(F.lit(AS_OF), 90).alias("contract_end"),
        F.lit(False).alias("auto_renew"),
    )
    return first.unionByName(second)


class Billing:
    """The five billing tables of one source, each built on first use (a
    report only plans the tables it reads)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    @cached_property
    def accounts(self) -> DataFrame:
        return accounts(self._spark, self._dir)

    @cached_property
    def invoices(self) -> DataFrame:
        return invoices(self._spark, self._dir)

    @cached_property
    def payments(self) -> DataFrame:
        return payments(self._spark, self._dir)

    @cached_property
    def contracts(self) -> DataFrame:
        return contracts(self._spark, self._dir)

    @cached_property
    def credit_memos(self) -> DataFrame:
        return credit_memos(self._spark, self._dir)


def billing(spark: SparkSession, sf_dir: str) -> Billing:
    """The billing tables of ``sf_dir``; the lazy plans are shared within a session."""
    return session_plan(spark, ("billing", sf_dir), lambda: Billing(spark, sf_dir))


# --------------------------------------------------------------------------
# Monthly series
# --------------------------------------------------------------------------

def _orders_by_customer_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pre-aggregate orders to (customer, month) before any join: the shuffle then
    # carries at most one row per key and map task (partial aggregation), so a
    # customer holding a large share of orders does not skew it.
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    return o.groupBy(
        F.col("o_custkey").alias("custkey"),
        F.trunc(_date(F.col("o_orderdate")), "month").alias("month"),
    ).agg(F.sum(_money(F.col("o_totalprice"))).alias("amount"))


def monthly_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_plan(spark, ("monthly_revenue_by_nation", sf_dir),
                        lambda: _monthly_revenue_by_nation(spark, sf_dir))


def _monthly_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account = nation name, month, revenue): one series per nation."""
    cm = _orders_by_customer_month(spark, sf_dir)
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return (
        cm.join(customer, cm.custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .groupBy(F.col("n_name").alias("account"), "month")
        .agg(F.sum("amount").cast("double").alias("revenue"))
    )


def monthly_revenue_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_plan(spark, ("monthly_revenue_by_customer", sf_dir),
                        lambda: _monthly_revenue_by_customer(spark, sf_dir))


def _monthly_revenue_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account = customer name, month, revenue): many short, gappy series."""
    cm = _orders_by_customer_month(spark, sf_dir)
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return cm.join(customer, cm.custkey == customer.c_custkey).select(
        F.col("c_name").alias("account"), "month", F.col("amount").cast("double").alias("revenue"),
    )


def monthly_metrics_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_plan(spark, ("monthly_metrics_by_nation", sf_dir),
                        lambda: _monthly_metrics_by_nation(spark, sf_dir))


def _monthly_metrics_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide per-nation monthly table with several metrics (revenue, orders,
    discount_given) for the multi-metric pulse. Line items are summed per
    order and orders per (customer, month) before any join with customers."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(_money(F.col("l_extendedprice")) * F.col("l_discount").cast("decimal(4,2)")).alias("discount_given")
    )
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    per_cust_month = (
        o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
        .groupBy(F.col("o_custkey").alias("custkey"),
                 F.trunc(_date(F.col("o_orderdate")), "month").alias("month"))
        .agg(F.sum(_money(F.col("o_totalprice"))).alias("revenue"),
             F.count(F.lit(1)).alias("orders"),
             F.sum("discount_given").alias("discount_given"))
    )
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return (
        per_cust_month.join(customer, per_cust_month.custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .groupBy(F.col("n_name").alias("account"), "month")
        .agg(
            F.sum("revenue").cast("double").alias("revenue"),
            F.sum("orders").cast("double").alias("orders"),
            F.coalesce(F.sum("discount_given"), F.lit(0)).cast("double").alias("discount_given"),
        )
    )


# --------------------------------------------------------------------------
# Freight
# --------------------------------------------------------------------------

def freight_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One freight line per line item: carrier from the supplier, lane = part
    brand, mode/container from part size; paid in full for finished lines
    (linestatus F), else floor(billed × (1 − discount))."""
    li = read_table(spark, sf_dir, "lineitem",
                    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                    "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    size = F.col("p_size")
    billed = _money(F.col("l_extendedprice"))
    arrived = _date(F.col("l_shipdate"))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("account_id"),
        F.concat(F.lit("C"), (F.col("l_suppkey") % 10).cast("string")).alias("carrier"),
        F.col("p_brand").alias("lane"),
        F.when(size > 45, "AIR").otherwise("OCEAN").alias("mode"),
        F.when(size > 45, "AIR").when(size <= 15, "LCL").when(size <= 30, "FCL 20'").otherwise("FCL 40'").alias("container"),
        _money(F.col("l_quantity")).alias("qty"),
        billed.alias("billed"),
        F.when(F.col("l_linestatus") == "F", billed)
        .otherwise(F.floor(billed * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)).alias("paid"),
        arrived.alias("arrived"),
        F.date_add(arrived, (F.col("l_partkey") % 15).cast("int")).alias("delivered"),
    )


def rate_basis(fi: DataFrame) -> DataFrame:
    """Floor of the mid unit price per (carrier, lane, container) of the freight lines."""
    unit = F.floor(F.col("billed").cast("double") / F.nullif(F.col("qty").cast("double"), F.lit(0.0)))
    return fi.groupBy("carrier", "lane", "container").agg(
        F.floor((F.min(unit) + F.max(unit)) / 2).cast(MONEY).alias("rate")
    )


def contract_rates_from(basis: DataFrame) -> DataFrame:
    """Contracted rate per (carrier, lane, container); keys with
    (carrier digit + length(lane)) % 4 = 0 are left out, and carrier C3 has a
    second, later row that the lookup must ignore."""
    digit = F.substring("carrier", 2, 4).cast("int")
    kept = basis.filter((digit + F.length("lane")) % 4 != 0)
    first = kept.withColumn("ordinal", F.lit(1))
    later = kept.filter(F.col("carrier") == "C3").select(
        "carrier", "lane", "container", (F.col("rate") + 1).cast(MONEY).alias("rate"), F.lit(2).alias("ordinal"))
    return first.unionByName(later)


def spot_quotes_from(basis: DataFrame) -> DataFrame:
    """Spot quotes for even carriers, 10 % above the basis rate (floored)."""
    digit = F.substring("carrier", 2, 4).cast("int")
    return basis.filter(digit % 2 == 0).select(
        "carrier", "lane", "container", F.floor(F.col("rate") * F.lit(Decimal("1.1"))).cast(MONEY).alias("rate"),
        F.lit(1).alias("ordinal"))


def contract_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_rates_from(rate_basis(freight_invoices(spark, sf_dir)))


def spot_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_quotes_from(rate_basis(freight_invoices(spark, sf_dir)))


class Freight:
    """Freight lines, rate tables and tolerance rules of one source, each
    built once on first use; the rate tables share one basis, a small table
    written when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    @cached_property
    def invoices(self) -> DataFrame:
        return freight_invoices(self._spark, self._dir)

    @cached_property
    def basis(self) -> DataFrame:
        # One row per rate key. Written as the table that both rate tables
        # read, so the lines are scanned for it once and Spark knows its size.
        path = scratch_folder(self._spark, "rate_basis")
        basis = rate_basis(self.invoices)
        basis.coalesce(1).write.parquet(path)
        return self._spark.read.schema(basis.schema).parquet(path)

    @cached_property
    def contract_rates(self) -> DataFrame:
        return contract_rates_from(self.basis)

    @cached_property
    def spot_quotes(self) -> DataFrame:
        return spot_quotes_from(self.basis)

    @cached_property
    def rules(self) -> DataFrame:
        return tolerance_rules(self._spark, self._dir)


def freight(spark: SparkSession, sf_dir: str) -> Freight:
    return Freight(spark, sf_dir)


def tolerance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per supplier account: flat dollars ($0.01 … $100) for even
    keys, a percentage for odd keys; free days and a daily demurrage rate."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    flat = (F.when(k % 5 == 0, 0.01).when(k % 5 == 1, 1).when(k % 5 == 2, 10)
            .when(k % 5 == 3, 50).otherwise(100))
    pct = F.when(k % 3 == 0, 0.02).when(k % 3 == 1, 0.05).otherwise(0.10)
    return s.select(
        k.alias("account_id"),
        F.when(k % 2 == 0, "flat").otherwise("pct").alias("kind"),
        F.when(k % 2 == 0, flat).otherwise(pct).cast("decimal(18,4)").alias("tolerance"),
        (3 + k % 5).cast("int").alias("free_days"),
        (75 + 25 * (k % 4)).cast(MONEY).alias("day_rate"),
    )


# --------------------------------------------------------------------------
# Recovery model
# --------------------------------------------------------------------------

def recovery_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item is an audited error worth price × discount, in the month
    it shipped; returnflag A → caught pre-audit, R → recovered post-audit,
    N → leaked. Error type from the line number."""
    li = read_table(spark, sf_dir, "lineitem", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    types = F.array(*[F.lit(t) for t in ERROR_TYPES])
    return li.select(
        F.trunc(_date(F.col("l_shipdate")), "month").alias("month"),
        F.element_at(types, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("error_type"),
        F.when(F.col("l_returnflag") == "A", "PRE").when(F.col("l_returnflag") == "R", "POST")
        .otherwise("LEAKED").alias("channel"),
        (_money(F.col("l_extendedprice")) * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)").alias("amount"),
    )


def recovery_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, channel, rate): per month of shipping, 4 to 6 % for the pre-audit
    and 25 to 31 % for the post-audit, by the month's number of line items."""
    li = read_table(spark, sf_dir, "lineitem", "l_shipdate")
    months = li.groupBy(F.trunc(_date(F.col("l_shipdate")), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    rate = lambda least, kinds: ((F.lit(least) + F.col("n") % kinds) / 100).cast("decimal(6,4)")
    return months.select("month", F.explode(F.array(
        F.struct(F.lit("PRE").alias("channel"), rate(4, 3).alias("rate")),
        F.struct(F.lit("POST").alias("channel"), rate(25, 7).alias("rate")))).alias("c")).select("month", "c.channel", "c.rate")


# --------------------------------------------------------------------------
# Text columns for pattern tagging
# --------------------------------------------------------------------------

def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", "page_id", "html").select(
        F.col("page_id").alias("id"), F.col("html").alias("text"))


def register_billing_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the five adapted billing tables as temp views
    (``accounts invoices payments contracts credit_memos``) for Spark SQL."""
    b = billing(spark, sf_dir)
    for name in ("accounts", "invoices", "payments", "contracts", "credit_memos"):
        getattr(b, name).createOrReplaceTempView(name)

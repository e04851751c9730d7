"""Explicit schemas of the tables the reports consume.

Money is DECIMAL(18,2) so sums are exact and independent of row order.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("csm_owner", T.StringType()),
])

INVOICES = T.StructType([
    T.StructField("invoice_id", T.LongType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("invoice_date", T.DateType()),
    T.StructField("due_date", T.DateType()),
    T.StructField("amount_due", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("billing_period_start", T.DateType()),
    T.StructField("billing_period_end", T.DateType()),
    T.StructField("product_line", T.StringType()),
])

PAYMENTS = T.StructType([
    T.StructField("payment_id", T.LongType()),
    T.StructField("invoice_id", T.LongType()),
    T.StructField("payment_date", T.DateType()),
    T.StructField("amount_paid", MONEY),
    T.StructField("payment_method", T.StringType()),
])

CONTRACTS = T.StructType([
    T.StructField("contract_id", T.LongType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("contracted_arr", MONEY),
    T.StructField("billing_frequency", T.StringType()),
    T.StructField("contract_start", T.DateType()),
    T.StructField("contract_end", T.DateType()),
    T.StructField("auto_renew", T.BooleanType()),
])

CREDIT_MEMOS = T.StructType([
    T.StructField("memo_id", T.LongType()),
    T.StructField("invoice_id", T.LongType()),
    T.StructField("memo_date", T.DateType()),
    T.StructField("memo_amount", MONEY),
    T.StructField("reason_code", T.StringType()),
])

MONTHLY_SERIES = T.StructType([
    T.StructField("account", T.StringType()),
    T.StructField("month", T.DateType()),
    T.StructField("revenue", T.DoubleType()),
])

PATTERNS = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("category", T.StringType()),
])

FREIGHT_INVOICES = T.StructType([
    T.StructField("invoice_id", T.LongType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("carrier", T.StringType()),
    T.StructField("lane", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("qty", MONEY),
    T.StructField("billed", MONEY),
    T.StructField("paid", MONEY),
    T.StructField("arrived", T.DateType()),
    T.StructField("delivered", T.DateType()),
])

RATES = T.StructType([
    T.StructField("carrier", T.StringType()),
    T.StructField("lane", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("rate", MONEY),
    T.StructField("ordinal", T.IntegerType()),
])

TOLERANCE_RULES = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tolerance", T.DecimalType(18, 4)),
    T.StructField("free_days", T.IntegerType()),
    T.StructField("day_rate", MONEY),
])

RECOVERY_LINES = T.StructType([
    T.StructField("month", T.DateType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 4)),
])

"""Edge rules of the billing reports on tiny inline tables."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlens.plans import billing as B
from ledgerlens.sources import schemas as SC

AS_OF = dt.date(2001, 6, 30)


def day(n):
    """The due date that is ``n`` days before AS_OF."""
    return AS_OF - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [
        (1, "Acme", "GOLD", "EU", "ann"),
        (2, "Beta", "SILVER", "US", "bob"),
        (3, "Twin", "GOLD", "EU", "cy"),   # 3 and 4 share all four attributes
        (4, "Twin", "GOLD", "EU", "cy"),
    ]
    return spark.createDataFrame(rows, SC.ACCOUNTS)


def inv(i, acct, due, amount, status="open", start=dt.date(2001, 1, 1), end=dt.date(2001, 1, 31),
        line="A", invoice_date=dt.date(2001, 1, 1)):
    return (i, acct, invoice_date, due, D(str(amount)), status, start, end, line)


@pytest.fixture(scope="module")
def invoices(spark):
    rows = [
        inv(1, 1, day(30), 100),
        inv(2, 1, day(31), 200),
        inv(3, 1, day(60), 300),
        inv(4, 1, day(61), 400),
        inv(5, 1, day(90), 500),
        inv(6, 1, day(91), 600),
        inv(7, 1, day(-5), 700),           # not yet due: in the total, in no bucket
        inv(8, 1, None, 800),              # NULL due date: in the total, no bucket, no effect on max
        inv(9, 1, day(200), 900, None),    # NULL status: dropped
        inv(10, 1, day(200), 0),           # zero amount: dropped
        inv(11, 1, day(200), -50),         # negative amount: dropped
        inv(12, 99, day(200), 1000),       # orphan account: dropped by the inner join
        inv(13, 1, day(200), 1000, "paid"),
        inv(14, 3, day(10), 10),
        inv(15, 4, day(10), 20),
    ]
    return spark.createDataFrame(rows, SC.INVOICES)


def test_aging_buckets_and_nulls(spark, invoices, accounts):
    rows = {r["account_name"]: r.asDict() for r in B.aging_receivables(invoices, accounts, AS_OF).collect()}
    a = rows["Acme"]
    assert a["open_invoice_count"] == 8
    assert a["total_outstanding"] == D("3600.00")
    assert a["bucket_1_30"] == D("100.00")
    assert a["bucket_31_60"] == D("500.00")      # 31 and 60
    assert a["bucket_61_90"] == D("900.00")      # 61 and 90
    assert a["bucket_90_plus"] == D("600.00")    # 91
    assert a["max_days_outstanding"] == 91
    assert a["collection_priority"] == "STANDARD"
    assert "Beta" not in rows


def test_accounts_sharing_attributes_merge(spark, invoices, accounts):
    rows = {r["account_name"]: r for r in B.aging_receivables(invoices, accounts, AS_OF).collect()}
    assert rows["Twin"]["open_invoice_count"] == 2
    assert rows["Twin"]["total_outstanding"] == D("30.00")


def test_collection_priority_thresholds(spark, accounts):
    rows = [
        inv(1, 1, day(95), 10000),          # exactly 10000 past 90: not ESCALATE
        inv(2, 2, day(95), 5001),           # >60 sum includes >90 amounts
        inv(3, 3, day(95), 10000.01),
    ]
    df = spark.createDataFrame(rows, SC.INVOICES)
    got = {r["csm_owner"]: r["collection_priority"] for r in B.aging_receivables(df, accounts, AS_OF).collect()}
    assert got == {"ann": "PRIORITY FOLLOW-UP", "bob": "PRIORITY FOLLOW-UP", "cy": "ESCALATE"}


def test_shortfall_threshold_payments_and_credits(spark, accounts):
    invs = spark.createDataFrame([
        inv(1, 1, day(10), "100.00"),   # paid 99.99 → gap 0.01, not > 0.01
        inv(2, 1, day(10), "100.00"),   # paid 99.98 → gap 0.02
        inv(3, 1, day(10), "100.00"),   # nothing paid
        inv(4, 1, day(10), "100.00"),   # two payments + a credit close it
        inv(5, 1, day(10), "100.00", "void"),
    ], SC.INVOICES)
    pays = spark.createDataFrame([
        (1, 1, dt.date(2001, 1, 5), D("99.99"), "wire"),
        (2, 2, dt.date(2001, 1, 5), D("99.98"), "wire"),
        (3, 4, dt.date(2001, 1, 5), D("50.00"), "wire"),
        (4, 4, dt.date(2001, 2, 5), D("40.00"), "card"),
    ], SC.PAYMENTS)
    credits = spark.createDataFrame([
        (1, 4, dt.date(2001, 2, 6), D("10.00"), "X"),
        (2, 777, dt.date(2001, 2, 6), D("10.00"), "X"),   # credit without invoice
    ], SC.CREDIT_MEMOS)
    out = {r["invoice_id"]: r for r in B.payment_shortfall(invs, pays, credits, accounts, AS_OF).collect()}
    assert set(out) == {2, 3}
    assert out[3]["payment_count"] == 0 and out[3]["last_payment_date"] is None
    assert out[3]["pct_paid"] == 0.0
    assert out[2]["pct_paid"] == 99.98
    assert out[2]["days_past_due"] == 10


def test_duplicates_null_period_and_id_order(spark, accounts):
    rows = [
        inv(5, 1, day(1), 100, start=None),
        inv(3, 1, day(1), 150, start=None),
        inv(9, 1, day(1), 120, start=None),
        inv(4, 1, day(1), 99, "void", start=None),   # void is not a duplicate
        inv(7, 2, day(1), 10),
    ]
    df = spark.createDataFrame(rows, SC.INVOICES)
    for chunk in (1, 4, 1 << 16):   # id ranges of 1 and 4 split the group's list into pieces
        out = B.duplicate_charges(df, accounts, id_chunk=chunk).collect()
        assert len(out) == 1
        r = out[0]
        assert r["duplicate_count"] == 3
        assert r["invoice_ids"] == "3, 5, 9"
        assert r["total_billed"] == D("370.00") and r["expected_charge"] == D("100.00")
        assert r["overcharge_amount"] == D("270.00")


def _contract(cid, acct, arr, end, auto=False):
    return (cid, acct, D(str(arr)), "annual", dt.date(2000, 1, 1), end, auto)


def test_contract_variance_rules(spark, accounts):
    invs = spark.createDataFrame([
        inv(1, 1, day(1), 1000, invoice_date=dt.date(2001, 2, 1)),
        inv(2, 1, day(1), 30, "paid", invoice_date=dt.date(2001, 3, 1)),
        inv(3, 1, day(1), 999, invoice_date=dt.date(2000, 12, 31)),   # before the year start
        inv(4, 2, day(1), 500, invoice_date=dt.date(2001, 1, 1)),
    ], SC.INVOICES)
    contracts = spark.createDataFrame([
        _contract(10, 1, 1000, AS_OF),                                  # ends on as_of: active; OVER by 3 %
        _contract(11, 1, 2000, AS_OF + dt.timedelta(days=90)),          # same account, whole billing again
        _contract(12, 2, 0, AS_OF + dt.timedelta(days=91)),             # ARR 0: ratio NULL → OVER-BILLED
        _contract(13, 3, 700, AS_OF + dt.timedelta(days=200)),          # no billing: IN LINE, NULL variance
        _contract(14, 4, 700, AS_OF - dt.timedelta(days=1)),            # expired
    ], SC.CONTRACTS)
    out = B.contract_variance(contracts, invs, accounts, AS_OF).collect()
    by_arr = {r["contracted_arr"]: r for r in out}
    assert len(out) == 4
    assert by_arr[D("1000.00")]["billing_status"] == "OVER-BILLED"
    assert by_arr[D("1000.00")]["arr_variance"] == D("30.00")
    assert by_arr[D("1000.00")]["renewal_flag"] == "RENEWAL RISK"
    assert by_arr[D("2000.00")]["billing_status"] == "REVIEW REQUIRED"
    assert by_arr[D("2000.00")]["renewal_flag"] == "RENEWAL RISK"     # ends exactly on as_of + 90
    assert by_arr[D("0.00")]["billing_status"] == "OVER-BILLED"
    assert by_arr[D("0.00")]["variance_pct"] is None
    assert by_arr[D("0.00")]["renewal_flag"] is None                  # as_of + 91
    assert by_arr[D("700.00")]["billing_status"] == "IN LINE"
    assert by_arr[D("700.00")]["arr_variance"] is None
    assert by_arr[D("1000.00")]["periods_billed"] == 1


def test_leakage_summary_all_vectors_empty(spark):
    empty_inv = spark.createDataFrame([], SC.INVOICES)
    empty_pay = spark.createDataFrame([], SC.PAYMENTS)
    empty_con = spark.createDataFrame([], SC.CONTRACTS)
    out = B.leakage_summary(empty_inv, empty_pay, empty_con, AS_OF).collect()
    assert len(out) == 4
    assert all(r["record_count"] == 0 and r["amount_at_risk"] is None and r["pct_of_total_risk"] is None
               for r in out)


def test_leakage_share_sums_to_100(spark, sf_small):
    from ledgerlens.sources import adapters as A

    b = A.billing(spark, sf_small)
    out = B.leakage_summary(b.invoices, b.payments, b.contracts, AS_OF).collect()
    assert abs(sum(r["pct_of_total_risk"] for r in out) - 100) <= 0.2


def test_monthly_exceptions_fanout_and_unpaid(spark, accounts):
    invs = spark.createDataFrame([inv(1, 1, day(1), 100), inv(2, 1, day(1), 50)], SC.INVOICES)
    pays = spark.createDataFrame([
        (1, 1, dt.date(2001, 1, 5), D("30.00"), "wire"),
        (2, 1, dt.date(2001, 1, 6), D("100.00"), "wire"),
    ], SC.PAYMENTS)
    out = sorted((r["invoice_id"], r["net_balance"]) for r in B.monthly_exceptions(invs, pays, accounts).collect())
    assert out == [(1, D("70.00")), (2, D("50.00"))]


def test_aging_bucket_count(spark, invoices):
    assert B.aging_bucket_count(invoices, AS_OF).collect()[0]["d90"] == 6


def test_billing_reports_bundle(spark, sf_small):
    from ledgerlens.sources import adapters as A

    b = A.billing(spark, sf_small)
    reports = B.billing_reports(b.invoices, b.payments, b.credit_memos, b.contracts, b.accounts, AS_OF)
    assert list(reports) == ["aging_receivables", "payment_shortfall", "duplicate_charges",
                             "contract_variance", "leakage_summary"]
    assert reports["leakage_summary"].count() == 4


def test_billing_views_answer_sql(spark, sf_small):
    from ledgerlens.sources import adapters as A

    A.register_billing_views(spark, sf_small)
    sql = spark.sql("""
        SELECT SUM(CASE WHEN datediff(DATE'2001-06-30', due_date) > 90 THEN 1 ELSE 0 END) AS d90 FROM invoices""")
    b = A.billing(spark, sf_small)
    assert sql.collect()[0]["d90"] == B.aging_bucket_count(b.invoices, AS_OF).collect()[0]["d90"]


def test_money_ratios_are_exact(spark):
    """A gap of just 5 % isn't above it, halves round up from the exact quotient, a zero whole gives NULL."""
    from pyspark.sql import functions as F

    from ledgerlens.functions import scalars as S

    rows = [("23.52", "22.40"), ("23.53", "22.40"), ("0.35", "1000.00"), ("-0.35", "1000.00"), ("-0.01", "1000.00"),
            ("1.00", "0.00"), (None, "5.00"), ("1.00", "-20.00")]
    df = spark.createDataFrame([(D(a) if a else None, D(b)) for a, b in rows], "a decimal(18,2), b decimal(18,2)")
    got = df.select(S.billing_status(F.col("a"), F.col("b")).alias("s"), S.percent_of(F.col("a"), F.col("b"), 2).alias("p")).collect()
    assert [r["s"] for r in got[:2]] == ["OVER-BILLED", "REVIEW REQUIRED"]
    assert [str(r["p"]) for r in got[2:]] == ["0.04", "-0.04", "0.0", "None", "None", "-5.0"]
    assert (got[5]["s"], got[6]["s"], got[7]["s"]) == ("OVER-BILLED", "IN LINE", "OVER-BILLED")

"""The parts that keep plans small or spread hot keys: salted joins, paged
lists, the one-pass summary, the recovery cube, the lossless pivot, profiles."""

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import windows as W
from ledgerlens.operators.sequence import numbered_within
from ledgerlens.operators.skew import hot_keys, salted_left_join
from ledgerlens import session
from ledgerlens.plans import anomaly as N
from ledgerlens.plans import billing as B
from ledgerlens.plans import freight as FR
from ledgerlens.plans import recovery as RC
from ledgerlens.registry import QUERIES
from ledgerlens.session import scratch_folder
from ledgerlens.sources import adapters as A
from ledgerlens.sources import files as IO
from ledgerlens.sources import schemas as SC


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- salted left join

def test_salted_join_equals_the_plain_one(spark):
    rnd = random.Random(2)
    left = spark.createDataFrame([(k, f"l{i}") for i, k in enumerate([1, 1, 2, 3, None, 5, 7])], "k long, name string")
    # A third of all rows, and alike, belong to one key.
    rows = [(1, 10)] * 400 + [(rnd.choice([2, 2, 3, 4, None]), rnd.randrange(9)) for _ in range(800)] + [(5, 1)]
    right = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k long, amount long").repartition(5)
    want = sorted(map(tuple, left.join(right.drop("id"), "k", "left").collect()), key=str)
    hot = hot_keys(right, "k", hot_rows=50)
    assert hot.keys() == {1, 2, 3, 4} and hot[1] == 9
    salted = salted_left_join(left, right, "k", hot, ["id"])
    assert salted.columns == ["k", "name", "amount"]
    assert sorted(map(tuple, salted.collect()), key=str) == want
    assert sorted(map(tuple, salted_left_join(left, right, "k", {}, ["id"]).collect()), key=str) == want
    # The hot key's rows are dealt about evenly over its salts.
    salts = [r["n"] for r in right.filter("k = 1").groupBy(F.pmod(F.xxhash64("id"), F.lit(9))).agg(F.count("*").alias("n")).collect()]
    assert len(salts) == 9 and max(salts) < 80
    assert hot_keys(right.limit(0), "k") == {} and hot_keys(right, "k") == {}


def test_fanout_reads_and_exchanges_each_side_once(spark, sf_small):
    plan = plan_of(QUERIES["left_join_fanout"](spark, sf_small))
    assert plan.count("FileScan") == 2 and "Union" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) <= 2
    plan = plan_of(QUERIES["monthly_exceptions"](spark, sf_small))
    assert plan.count("FileScan parquet") <= 5 and "LeftAnti" not in plan


def test_monthly_exceptions_with_a_hot_invoice(spark):
    day = dt.date(2001, 1, 1)
    invoices = spark.createDataFrame([(i, 1, day, day, D(100 * i), "open", day, day, "A") for i in range(1, 6)], SC.INVOICES)
    payments = spark.createDataFrame([(j, 3, day, D(j % 7), "card") for j in range(300)] + [(900, 1, day, D(100), "card")], SC.PAYMENTS)
    accounts = spark.createDataFrame([(1, "Acme", "t", "r", "o")], SC.ACCOUNTS)
    plain = B.monthly_exceptions(invoices, payments, accounts).collect()
    assert sorted(B.monthly_exceptions(invoices, payments, accounts, hot_rows=20).collect()) == sorted(plain) and len(plain) == 303


# ---------------------------------------------------------------- paged lists

def test_pages_of_a_group_with_a_third_of_the_rows(spark):
    day = dt.date(2001, 1, 1)
    rows = [(i, 1 if i % 3 == 0 else i, day, day, D(1), "open", None if i % 3 == 0 else day, day, "A") for i in range(900)]
    rows += [(i, 7_000_000, day, day, D(1), "open", day, day, "A") for i in (2_000, 2_001)]
    pages = B.duplicate_id_pages(spark.createDataFrame(rows, SC.INVOICES).repartition(7), page_ids=64)
    got = defaultdict(dict)
    for r in pages.collect():
        assert r["n_ids"] == len(r["invoice_ids"].split(", ")) <= 64
        got[r["account_id"]][r["page"]] = r["invoice_ids"]
    assert got.keys() == {1, 7_000_000} and len(got[1]) == 5
    assert ", ".join(got[1][p] for p in range(5)) == ", ".join(str(i) for i in range(0, 900, 3))
    assert got[7_000_000] == {0: "2000, 2001"}


def test_positions_within_keys(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i) for i in range(500)] + [("b", None)]
    frame = spark.createDataFrame(rows, "k string, o long").repartition(6)
    seen = defaultdict(list)
    for r in numbered_within(frame, ["k"], "o", partitions=5).collect():
        seen[r["k"]].append((r["_idx"], r["o"]))
    for k, found in seen.items():
        order = sorted((o for kk, o in rows if kk == k), key=lambda o: (o is None, o))
        assert sorted(found) == list(enumerate(order, 1))


# ---------------------------------------------------------------- blocks with a halo

def series_rows(seed, n=700):
    """Long and short keys, values missing, some months far more crowded than others."""
    rnd = random.Random(seed)
    out = []
    for k, size in (("a", n), ("b", n // 7), (None, n // 3), ("c", 3)):
        at = sorted(rnd.sample(range(10 * n), size)) if k != "b" else [x // 3 for x in range(3 * size, 6 * size, 3)]
        out += [(k, o, rnd.choice([None, rnd.random() * 9, 5.0, 5.0])) for o in at]
    return out + [("a", None, 1.5)]


@pytest.mark.parametrize("block_rows, seed", [(6, 1), (9, 2), (64, 3), (5000, 4)])
def test_blocks_give_the_plain_windows(spark, block_rows, seed):
    frame = spark.createDataFrame(series_rows(seed), "k string, o long, v double").repartition(5)
    for keys in (["k"], []):
        part = frame if keys else frame.filter("k = 'a'")
        plain = N.strict_baseline(part, "v", keys, "o", 6, split_rows=0)
        split = N.strict_baseline(part, "v", keys, "o", 6, split_rows=block_rows)
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("order", ["ts", "day", "name", "both"])
def test_blocks_by_any_order(spark, order):
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(minutes=7 * i), dt.date(2001, 1, 1) + dt.timedelta(days=i), f"row{i:05d}", i, float(i % 13)) for i in range(400)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, day date, name string, i long, v double").withColumn("both", F.struct("ts", "i"))
    plain = N.strict_baseline(frame, "v", [], order, 6, split_rows=0).select("i", "baseline", "spread")
    split = N.strict_baseline(frame, "v", [], order, 6, split_rows=40)
    assert sorted(map(tuple, split.select("i", "baseline", "spread").collect())) == sorted(map(tuple, plain.collect()))


def test_one_exchange_of_all_rows(spark):
    """All rows are exchanged once, by the window; what the copies take is limited before it is exchanged."""
    frame = spark.createDataFrame(series_rows(5), "k string, o long, v double")
    plan = plan_of(N.metric_flag(frame, "v", ["k"], "o", split_rows=50))
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :|+-*"))
    moved = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            under = [x for x in lines[i + 1:]]
            under = under[:next((j for j, x in enumerate(under) if depth(x) <= depth(line)), len(under))]
            moved.append(any(re.search("WindowGroupLimit|Aggregate", x) for x in under[:4]) or "WindowGroupLimit" in "".join(under) and "Union" not in "".join(under))
    assert moved.count(False) == 1


def test_blocks_grow_with_a_long_series(spark):
    """However long a series, its rows are placed among no more cuts than the shuffle has use for; the windows stay the plain ones."""
    frame = spark.range(4000).select(F.lit("a").alias("k"), F.col("id").alias("o"), (F.col("id") % 17 % 5).cast("double").alias("v"))
    most = W.BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in W.with_blocks(frame, ["k"], "o", 10).groupBy("_block").count().collect()]
    assert len(sizes) == most < 4000 / 10 and max(sizes) < 2 * 4000 / most
    plain = N.strict_baseline(frame, "v", ["k"], "o", 6, split_rows=0)
    split = N.strict_baseline(frame, "v", ["k"], "o", 6, split_rows=10)
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_cuts_below_a_value(spark):
    rnd = random.Random(7)
    for n in (1, 2, 3, 7, 8, 30):
        rows = [(sorted(rnd.choices(range(n), k=n)), x) for x in range(-1, n + 1)]
        frame = spark.createDataFrame(rows, "cuts array<int>, lead int")
        got = {r["lead"]: r["n"] for r in frame.select("lead", W._cuts_below(F.col("cuts"), F.col("lead"), n + 1).alias("n")).collect()}
        assert got == {x: sum(c < x for c in cuts) for cuts, x in rows}


def test_a_series_without_a_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(N, "KEYLESS_ROWS", 50)
    frame = spark.range(1000).select("id", (F.col("id") % 17).cast("double").alias("v"))
    flagged = N.metric_flag(frame, "v", order="id")
    assert "SinglePartition" not in plan_of(flagged).split("Window [")[1].split("Exchange")[1][:60]
    assert flagged.count() == N.metric_flag(frame, "v", order="id", split_rows=0).count() > 0


# ---------------------------------------------------------------- detector summary

def test_summary_is_one_detector_run(spark, sf_small):
    summary = QUERIES["anomaly_summary"](spark, sf_small)
    plan = plan_of(summary)
    assert "rangepartitioning" not in plan and "Sort [_raw_severity" not in plan
    one = plan_of(QUERIES["anomaly_series"](spark, sf_small))
    assert plan.count("FileScan") == one.count("FileScan") and plan.count("Window [") == one.count("Window [")
    parts = {(r["section"], r["label"], r["metric"]): r["value"] for r in summary.collect()}
    for r in QUERIES["anomaly_summary_by_type"](spark, sf_small).collect():
        for m in ("count", "avg_severity", "accounts_affected"):
            assert parts.pop(("by_type", r["anomaly_type"], m)) == r[m]
    for r in QUERIES["anomaly_priority_counts"](spark, sf_small).collect():
        assert parts.pop(("by_priority", r["priority"], "count")) == r["count"]
    head = QUERIES["anomaly_headline"](spark, sf_small).first().asDict()
    assert {m: v for (_, _, m), v in parts.items()} == head


def test_summary_of_an_empty_and_a_quiet_series(spark):
    schema = "account string, month date, revenue double"
    none = N.summary_table(N.anomaly_series(spark.createDataFrame([], schema)))
    assert {(r["section"], r["metric"]): r["value"] for r in none.collect() if r["section"] == "headline"} == {
        ("headline", m): 0.0 for m in ("accounts_analyzed", "months_analyzed", "anomalies_flagged", "high_priority_accounts")}
    quiet = spark.createDataFrame([(a, dt.date(2001, m, 1), 5.0) for a in ("x", None) for m in range(1, 10)], schema)
    got = [tuple(r) for r in N.summary_table(N.anomaly_series(quiet)).collect()]
    assert not [r for r in got if r[0] == "by_type"] and ("headline", None, "months_analyzed", 9.0) in got
    assert ("headline", None, "accounts_analyzed", 1.0) in got


# ---------------------------------------------------------------- recovery

LINES = "month date, error_type string, channel string, amount decimal(18,4)"


@pytest.fixture(scope="module")
def lines(spark):
    m = [dt.date(2001, 1, 1), dt.date(2001, 2, 1)]
    return spark.createDataFrame([
        (m[0], "a", "PRE", D(10)), (m[0], "a", "LEAKED", D(5)), (m[0], "b", "POST", D(4)), (m[0], "Z", "PRE", D(5)),
        (m[1], "a", "POST", D(2)), (m[1], None, "PRE", D(1)), (m[1], "b", "PRE", D(3))], LINES)


def test_pivot_loses_nothing(lines):
    pool = {r["month"]: r["pool"] for r in lines.groupBy("month").agg(F.sum("amount").alias("pool")).collect()}
    for matrix in (RC.error_month_matrix(lines, ["a", "b"]), RC.error_month_matrix(lines), RC.error_month_matrix(lines, most=1),
                   RC.error_month_matrix(lines, [])):
        assert matrix.columns[-1] == "other"
        for r in matrix.collect():
            assert sum(v or 0 for v in r[1:]) == pool[r["month"]]
    named = {r["month"].month: r.asDict() for r in RC.error_month_matrix(lines, ["a", "b"]).collect()}
    assert named[1]["other"] == 5 and named[2]["other"] == 1 and named[1]["a"] == 15
    assert RC.error_month_matrix(lines).columns == ["month", "Z", "a", "b", "other"]


def test_recovery_cube_with_costs(spark, lines):
    costs = spark.createDataFrame([(dt.date(2001, 1, 1), "PRE", D("0.05")), (dt.date(2001, 1, 1), "POST", D("0.25")),
                                   (dt.date(2001, 2, 1), "PRE", D("0.02")), (dt.date(2001, 2, 1), "PRE", D("0.02"))],
                                  "month date, channel string, rate decimal(6,4)")
    cube = {(r["period"], r["error_type"]): r for r in RC.recovery_by_type(lines, costs, default_post=0.5).collect()}
    assert len(cube) == 13 and cube["FY", "ALL"]["level"] == 3 and cube["2001-02", None]["level"] == 0
    total = cube["FY", "ALL"]
    assert (total["pool"], total["avoided"], total["recovered"], total["leakage"], total["errors"]) == (30, 19, 6, 5, 7)
    assert total["pre_cost"] == D("0.91") and total["post_cost"] == 2  # 15 * 0.05 + 4 * 0.04, 4 * 0.25 + 2 * 0.5
    assert total["cost_multiple"] == pytest.approx((2 / 6) / (0.91 / 19))
    assert cube["FY", "a"]["catch_rate"] == pytest.approx(10 / 17) and cube["2001-01", "b"]["catch_rate"] == 0
    assert cube["2001-01", "b"]["cost_multiple"] is None
    # Without a default a month without a rate has no cost, nor has a total that holds it.
    bare = {(r["period"], r["error_type"]): r for r in RC.recovery_by_type(lines, costs).collect()}
    assert bare["FY", "ALL"]["post_cost"] is None and bare["2001-01", "ALL"]["post_cost"] == 1.0


def test_cube_joins_aggregated_rows_only(spark, sf_small):
    plan = plan_of(QUERIES["recovery_by_type"](spark, sf_small))
    join, expand, scan = (plan.index(x) for x in ("Join [", "Expand", "FileScan"))
    assert expand < join < scan and "HashAggregate" in plan[join:scan]


# ---------------------------------------------------------------- profiles

def test_column_profile(spark):
    rows = [(1, D("2.50"), "b", dt.date(1970, 1, 3), True), (2, None, "é", None, False), (2, D("-1.00"), None, dt.date(1969, 12, 31), None)]
    df = spark.createDataFrame(rows, "k int, amount decimal(9,2), name string, day date, flag boolean")
    got = {r["column_name"]: r.asDict() for r in IO.column_profile(df, "t").collect()}
    assert {c: (r["row_count"], r["null_count"], r["distinct_count"], r["total"], r["least"], r["greatest"]) for c, r in got.items()} == {
        "k": (3, 0, 2, 5, 1, 2), "amount": (3, 1, 2, D("1.5"), -1, D("2.5")), "name": (3, 1, 2, 2, 1, 1),
        "day": (3, 1, 2, 1, -1, 2), "flag": (3, 1, 2, 1, 0, 1)}
    assert (got["name"]["first_text"], got["name"]["last_text"]) == ("b", "é") and got["k"]["first_text"] is None
    assert IO.column_profile(df.limit(0), "t").collect() == []


def test_scan_reads_every_column(spark, sf_small):
    plan = plan_of(QUERIES["scan_billing"](spark, sf_small))
    read = set(re.findall(r"\b([ocln]_\w+)", " ".join(re.findall(r"FileScan parquet \[([^\]]*)\]", plan))))
    assert {"o_totalprice", "o_orderstatus", "o_orderpriority", "c_acctbal", "c_mktsegment", "l_extendedprice", "l_linestatus"} <= read


# ---------------------------------------------------------------- folders, jobs, order

def test_scratch_folders_are_new_and_shared(spark):
    a, b = (scratch_folder(spark, "x") for _ in range(2))
    shared = spark.conf.get("spark.checkpoint.dir")
    assert a != b and a.startswith(shared) and a.endswith("/x")
    spark.range(3).write.parquet(a)
    assert spark.read.parquet(a).count() == 3
    hooks = spark._jvm.org.apache.hadoop.fs.Path(a).getParent()
    assert hooks.getFileSystem(spark._jsc.hadoopConfiguration()).cancelDeleteOnExit(hooks)


def test_small_lookup_files_need_no_count(spark, sf_small, monkeypatch):
    """The rate tables are one small file, so no job counts them while the plan is built."""
    f = A.Freight(spark, sf_small)
    f.basis
    counted = []
    monkeypatch.setattr(session, "bounded_count", lambda df, limit: counted.append(limit) or 1)
    plan = plan_of(FR.audit_lines(f.invoices, f.contract_rates, f.spot_quotes, f.rules))
    assert not counted and plan.count("BroadcastHashJoin [carrier") == 2
    assert plan.count("lineitem.parquet") == 1


@pytest.mark.parametrize("name, order", [
    ("aging_receivables", lambda r: (-r["total_outstanding"], r["account_name"], r["tier"], r["region"], r["csm_owner"])),
    ("payment_shortfall", lambda r: (-r["net_balance_due"], r["invoice_id"])),
    ("leakage_summary", lambda r: (-r["amount_at_risk"], r["leakage_type"])),
    ("monthly_exceptions", lambda r: (-r["net_balance"], r["invoice_id"])),
])
def test_reports_come_in_order(spark, sf_small, name, order):
    rows = QUERIES[name](spark, sf_small).collect()
    assert rows == sorted(rows, key=order) and len(rows) > 1


def test_variance_and_anomalies_come_in_order(spark, sf_small):
    """R4 by the unrounded gap (no billing counts as 0 against the rate), R7 by the unrounded severity."""
    rows = QUERIES["contract_variance"](spark, sf_small).collect()
    gap = [abs((r["actual_arr_billed"] if r["actual_arr_billed"] is not None else r["contracted_arr"]) - r["contracted_arr"])
           if r["actual_arr_billed"] is not None else None for r in rows]
    known = [g for g in gap if g is not None]
    assert known == sorted(known, reverse=True) and all(g is None for g in gap[len(known):]) and len(rows) > 20
    report = QUERIES["anomaly_report"](spark, sf_small).collect()
    severity = [r["severity_score"] for r in report]
    assert severity == sorted(severity, reverse=True) and len(report) > 15

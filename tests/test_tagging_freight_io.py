"""Pattern tagging, list append, category stats, numbering, freight audit,
recovery model and file sources/sinks."""

import datetime as dt
import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.sequence import number_rows
from ledgerlens.plans import freight as FR
from ledgerlens.plans import recovery as RC
from ledgerlens.plans import tagging as G
from ledgerlens.sources import files as IO
from ledgerlens.sources import patterns as PT
from ledgerlens.sources import schemas as SC

UA = [
    (1, "Mozilla/5.0 (compatible; GPTBot/1.0; +https://openai.com/gptbot)"),
    (2, "omgilibot/0.3"),                         # omgili comes first in the list and shadows omgilibot
    (3, "Bombardier fleet tracker"),              # substring over-match on "Bard"
    (4, "CLAUDEBOT crawler"),                     # case-insensitive
    (5, ""),
    (6, None),
    (7, "curl/8.1.2"),
    (8, "Mozilla/5.0 (compatible; Googlebot/2.1)"),   # allowed bots are not consulted, no pattern matches
    (9, "python-requests/2.31 via Scrapy"),      # two patterns: lower ordinal (Scrapy) wins
]
EXPECTED = {1: "GPTBot", 2: "omgili", 3: "Bard", 4: "ClaudeBot", 5: "", 6: "", 7: "curl/", 8: "", 9: "Scrapy"}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(UA, "id long, text string")


@pytest.mark.parametrize("limit", [512, 0])   # CASE chain and gram index
def test_first_match_semantics(spark, texts, limit):
    out = {r["id"]: r for r in G.tag_patterns(texts, PT.default_patterns(spark), case_chain_limit=limit).collect()}
    assert {k: v["pattern"] for k, v in out.items()} == EXPECTED
    assert {k for k, v in out.items() if v["blocked"]} == {1, 2, 3, 4, 7, 9}
    assert out[9]["category"] == "generic" and out[1]["category"] == "ai" and out[5]["category"] is None


def test_tagging_plan_has_no_join_on_text(spark, texts):
    plan = G.tag_patterns(texts, PT.default_patterns(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_indexed_list_matches_the_case_chain(spark):
    """Both plans agree on lists of any shape: short names, repeats, an empty
    name, names that hold one another, texts repeated or without id."""
    rnd = random.Random(5)
    word = lambda a, b: "".join(rnd.choice("abAB/é") for _ in range(rnd.randint(a, b)))
    names = [word(1, 9) for _ in range(700)] + [None, "A", "ab", "Ab", "\U0001F600x", "a\nb"]
    texts = [(i if i % 7 else None, " ".join(word(1, 12) for _ in range(rnd.randint(0, 5)))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "q\U0001F600X"), (903, "zA\nBz"), (904, "zzz " * 5000), texts[3], texts[3]]
    frame = spark.createDataFrame(texts, "id long, text string").repartition(3)
    for some in (names, names[:40], [n for n in names if n and len(n) > 5], names + [""], []):
        listed = spark.createDataFrame([(3_000_000_000 + i, n, "x", rnd.choice([None, "ai"])) for i, n in enumerate(some)],
                                       "ordinal long, name string, company string, category string")
        want = sorted(map(tuple, G.tag_patterns(frame, listed, case_chain_limit=10_000).collect()), key=str)
        assert sorted(map(tuple, G.tag_patterns(frame, listed, case_chain_limit=-1).collect()), key=str) == want


def test_indexed_list_stays_distributed(spark, texts, monkeypatch):
    """One aggregate over the list when the plan is built, whatever its length; texts don't leave their scan with their grams."""
    names = spark.range(2000).select(F.col("id").alias("ordinal"), F.concat(F.lit("agent"), F.col("id").cast("string")).alias("name"),
                                     F.lit("c").alias("company"), F.lit("ai").alias("category"))
    tagged = G.tag_patterns(texts, names)
    assert [r["blocked"] for r in tagged.collect()] == [False] * len(UA)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "agent1999" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert re.search(r"BroadcastHashJoin \[gram", plan)
    monkeypatch.setattr(G, "INDEX_BROADCAST_LIMIT", 10)
    assert G.tag_patterns(texts, names).count() == len(UA)


def test_words_are_searched_once(spark):
    """Patterns without white space are looked for in distinct words: no grams of whole texts, no lists of patterns per text.
    With white space, in long words, at the ends of words and in repeated ids, the answer is that of the CASE expression."""
    names = ["abc", "bcde", "z", "de f", "f\t", "longer word", "tail9", "\u00e9t\u00e9", " "]
    texts = spark.createDataFrame([
        (1, "xxbcdexx ABC"), (1, "nothing"), (1, "nothing"), (None, "abcde f"), (2, None), (3, ""), (4, "a longer\nword"), (5, "A LONGER word"),
        (6, "x" * 200 + "Tail9"), (7, "q" * 70 + " tail" + " 9"), (8, "\u00c9T\u00c9!"), (9, "f\tg"), (10, "z"), (11, " lead")], "id long, text string")
    for some in (names, names[:3], names[3:6], names[5:8]):
        listed = spark.createDataFrame([(len(some) - i, n, "x", "ai") for i, n in enumerate(some)],
                                       "ordinal long, name string, company string, category string")
        want = sorted(map(tuple, G.tag_patterns(texts, listed, case_chain_limit=10_000).collect()), key=str)
        assert sorted(map(tuple, G.tag_patterns(texts, listed, case_chain_limit=-1).collect()), key=str) == want
    listed = spark.createDataFrame([(1, "abc", "x", "ai")], "ordinal long, name string, company string, category string")
    plan = G.tag_patterns(texts, listed, case_chain_limit=-1)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "regexp_extract_all(lower(text" not in plan


def test_the_registered_index_query_has_a_long_list(spark, sf_small):
    """Its list is beyond the CASE chain, so the query (held against its SQL) runs by the index."""
    from ledgerlens.registry import QUERIES, benchmark_word_patterns

    assert benchmark_word_patterns(spark, sf_small).count() > G.CASE_CHAIN_LIMIT
    plan = QUERIES["pattern_tagging_index"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "CASE WHEN Contains" not in plan


def test_append_new_patterns(spark):
    existing = PT.default_patterns(spark)
    incoming = spark.createDataFrame(
        [("gptbot", 1), ("NewBot", 5), ("newbot", 3), ("Zeta", 2), (None, 0)], "name string, page_id long")
    out = G.append_new_patterns(existing, incoming, "page_id").orderBy("ordinal").collect()
    assert len(out) == len(PT.DEFAULT_PATTERNS) + 2
    tail = [(r["ordinal"], r["name"], r["company"], r["category"]) for r in out[-2:]]
    n = len(PT.DEFAULT_PATTERNS)
    assert tail == [(n + 1, "Zeta", "unknown", "ai"), (n + 2, "newbot", "unknown", "ai")]


def test_category_stats_empty_and_unknown(spark):
    empty = spark.createDataFrame([], "category string")
    assert [tuple(r) for r in G.category_stats(empty).collect()] == [("TOTAL", 0)]
    df = spark.createDataFrame([("ai",), ("ai",), (None,), ("generic",)], "category string")
    assert [tuple(r) for r in G.category_stats(df).collect()] == [
        ("TOTAL", 4), ("ai", 2), ("generic", 1), ("unknown", 1)]


def test_number_rows_is_consecutive(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    got = number_rows(df, ["k"], start=10, partitions=4).orderBy("k").collect()
    assert [r["seq"] for r in got] == list(range(10, 5010))
    assert [r["k"] for r in got] == list(range(5000))


# ---------------------------------------------------------------- freight

def _fi(i, acct, carrier, billed, qty, paid, arrived=dt.date(2001, 1, 1), delivered=dt.date(2001, 1, 10)):
    return (i, 1, acct, carrier, "L1", "OCEAN", "LCL", D(str(qty)), D(str(billed)), D(str(paid)), arrived, delivered)


def test_freight_labels_rates_demurrage_shortpay(spark):
    fi = spark.createDataFrame([
        _fi(1, 1, "C1", "1000.00", "10", "1000.00"),   # contract 100 → expected 1000, within
        _fi(2, 2, "C1", "1060.00", "10", "1000.00"),   # 5 % rule: allowance 50 → overcharge, short pay
        _fi(3, 1, "C1", "995.00", "10", "0.00"),      # flat 10: within, nothing paid → balance due
        _fi(4, 1, "C2", "500.00", "5", "500.00"),      # no contract, spot 90 → expected 450 → overcharge
        _fi(5, 1, "C9", "100.00", "1", "100.00"),      # no rate at all
        _fi(6, 3, "C1", "900.00", "10", "900.00"),     # no rule: any difference is a label
    ], SC.FREIGHT_INVOICES)
    boxes = fi.where("invoice_id = 1").withColumn("container", F.explode(F.array(F.lit("FCL 20'"), F.lit("FCL 40'"))))
    contract = spark.createDataFrame([
        ("C1", "L1", "LCL", D("100.00"), 1), ("C1", "L1", "LCL", D("999.00"), 2),
        ("C1", "L1", "FCL 40'", D("20.00"), 1),
    ], SC.RATES)
    spot = spark.createDataFrame([("C2", "L1", "LCL", D("90.00"), 1), ("C1", "L1", "LCL", D("1.00"), 1)],
                                 SC.RATES)
    rules = spark.createDataFrame([
        (1, "flat", D("10"), 3, D("100.00")), (2, "pct", D("0.05"), 20, D("50.00")),
    ], SC.TOLERANCE_RULES)
    out = {r["invoice_id"]: r for r in FR.audit_lines(fi, contract, spot, rules).collect()}
    assert out[1]["audit_label"] == "WITHIN TOLERANCE" and out[1]["rate_source"] == "CONTRACT"
    assert out[1]["demurrage"] == D("600.00")                 # 9 days − 3 free × 100
    assert out[2]["audit_label"] == "OVERCHARGE" and out[2]["pay_status"] is None   # approved 1000, paid 1000
    assert out[2]["demurrage"] == D("0.00")                   # 9 days < 20 free: floored at 0
    assert out[3]["audit_label"] == "WITHIN TOLERANCE" and out[3]["pay_status"] == "BALANCE DUE: WITHIN TOLERANCE"
    assert out[4]["rate_source"] == "SPOT" and out[4]["audit_label"] == "OVERCHARGE"
    assert out[5]["audit_label"] == "RATE NOT ON FILE" and out[5]["rate_source"] == "NONE"
    assert out[6]["audit_label"] == "UNDERBILL"
    by_box = {r["container"]: r["expected"] for r in FR.audit_lines(boxes, contract, spot, rules).collect()}
    assert by_box == {"FCL 20'": None, "FCL 40'": D("200.00")}  # a rate is a container's own, not its mode's
    exc = {r["invoice_id"] for r in FR.exception_report(FR.audit_lines(fi, contract, spot, rules)).collect()}
    assert exc == {2, 3, 4, 5, 6}
    dash = FR.dashboard(FR.audit_lines(fi, contract, spot, rules))
    total = dash.filter("level = 'TOTAL'").collect()[0]
    assert total["lines"] == 6 and total["exceptions"] == 5


def test_recovery_dashboard_and_multiple(spark):
    rows = []
    for m, (pre, post, leak) in enumerate([(70, 20, 10)] * 7 + [(59, 31, 10)]):
        month = dt.date(2020, m + 1, 1)
        rows += [(month, "rate_error", "PRE", D(pre)), (month, "rate_error", "POST", D(post)),
                 (month, "fuel_surcharge", "LEAKED", D(leak))]
    lines = spark.createDataFrame(rows, SC.RECOVERY_LINES)
    dash = {r["period"]: r for r in RC.recovery_dashboard(lines).collect()}
    assert dash["FY"]["pool"] == D("800.0000") and dash["2020-01"]["catch_rate"] == pytest.approx(0.7)
    assert dash["2020-01"]["cost_multiple"] == pytest.approx(6.5)
    assert dash["FY"]["leakage"] == D("80.0000")
    flags = [r["period"] for r in RC.catch_rate_flags(RC.recovery_dashboard(lines)).collect()]
    assert flags == ["2020-08"]
    mat = RC.error_month_matrix(lines, ["rate_error", "fuel_surcharge", "weight_class"]).collect()
    assert len(mat) == 8 and mat[0]["weight_class"] is None


# ---------------------------------------------------------------- files

def test_monthly_revenue_csv(spark, tmp_path):
    p = tmp_path / "rev.csv"
    p.write_text("account,month,revenue\nA,2020-01-01,10.5\nA,2020-02-01,NaN\nB,2020-01-01,3\n")
    df = IO.read_monthly_revenue(spark, str(p))
    rows = sorted(df.collect(), key=lambda r: (r["account"], r["month"]))
    assert rows[0]["month"] == dt.date(2020, 1, 1) and rows[1]["revenue"] is None
    assert df.schema["month"].dataType.simpleString() == "date"


def test_report_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", "2020-01", 1.25, "HIGH")], "account string, month string, v double, p string")
    IO.write_report_csv(df, str(tmp_path / "out"))
    back = IO.read_report_csv(spark, str(tmp_path / "out"), df.schema)
    assert back.collect() == df.collect()


def test_pattern_list_json_round_trip(spark, tmp_path):
    src = tmp_path / "list.json"
    src.write_text('{"version": "2.0.0", "updated": "2024-01-01", "user_agents": ['
                   '{"name": "B", "company": "x", "category": "ai"}, {"name": "A", "company": "y"}],'
                   ' "allowed_search_bots": ["Googlebot"]}')
    pats = PT.read_pattern_list(spark, str(src))
    assert [(r["ordinal"], r["name"], r["category"]) for r in pats.orderBy("ordinal").collect()] == [
        (1, "B", "ai"), (2, "A", None)]
    PT.write_pattern_list(pats, str(tmp_path / "out"))
    again = PT.read_pattern_list(spark, str(tmp_path / "out"))
    assert [r["name"] for r in again.orderBy("ordinal").collect()] == ["B", "A"]


def test_reconcile_statuses(spark):
    a = spark.createDataFrame([(1, D("10.00")), (2, D("5.00")), (3, D("7.00")), (3, D("1.00"))], "k long, amt decimal(18,2)")
    b = spark.createDataFrame([(2, D("5.01")), (3, D("9.00")), (4, D("1.00"))], "k long, amt decimal(18,2)")
    got = {r["k"]: r["status"] for r in IO.reconcile(a, b, "k", "amt", "left", "right").collect()}
    assert got == {1: "ONLY_IN_LEFT", 2: "MATCHED", 3: "AMOUNT_MISMATCH", 4: "ONLY_IN_RIGHT"}


def test_reconcile_any_number_of_sources(spark):
    make = lambda rows: spark.createDataFrame([(k, D(a) if a else None) for k, a in rows], "k long, amt decimal(18,2)")
    got = {r["k"]: (r["status"], r["missing_in"], r["spread"]) for r in IO.reconcile_all({
        "x": make([(1, "5.00"), (2, "3.00"), (2, "4.00"), (3, "1.00"), (4, "2.00"), (None, "1.00")]),
        "y": make([(1, "5.01"), (2, "7.00"), (3, "1.00"), (4, None)]),
        "z": make([(1, "5.00"), (2, "7.02"), (4, "2.00")])}, "k", "amt").collect()}
    assert got == {1: ("MATCHED", "", D("0.01")), 2: ("AMOUNT_MISMATCH", "", D("0.02")), 3: ("INCOMPLETE", "z", D("0.00")),
                   4: ("AMOUNT_MISMATCH", "", D("0.00")), None: ("INCOMPLETE", "y,z", D("0.00"))}
    with pytest.raises(ValueError):
        IO.reconcile_all({"x": make([(1, "5.00")])}, "k", "amt")


def test_billing_tables_round_trip(spark, sf_small, tmp_path):
    from ledgerlens.plans import billing as B
    from ledgerlens.sources import adapters as A

    src = A.billing(spark, sf_small)
    IO.write_billing_tables(src, str(tmp_path / "billing"))
    got = IO.read_billing_tables(spark, str(tmp_path / "billing"))
    assert got.invoices.schema == SC.INVOICES
    r1 = sorted(tuple(r) for r in B.aging_receivables(got.invoices, got.accounts, A.AS_OF).collect())
    r1_src = sorted(tuple(r) for r in B.aging_receivables(src.invoices, src.accounts, A.AS_OF).collect())
    assert r1 == r1_src
    r5 = {r["leakage_type"]: r["record_count"]
          for r in B.leakage_summary(got.invoices, got.payments, got.contracts, A.AS_OF).collect()}
    assert len(r5) == 4

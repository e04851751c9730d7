"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the driver's raw tables (views ``region nation
customer supplier part orders lineitem ...``). The adapters of
``ledgerlens.sources.adapters`` are repeated here as CTE text, so the oracle
is an independent statement of the same derivation.

Output types are pinned on both sides: money → DOUBLE, counts and day
counts → BIGINT.
"""

from __future__ import annotations

AS_OF = "DATE '2001-06-30'"
YEAR_START = "DATE '2001-01-01'"

# ---------------------------------------------------------------- adapters

ACCOUNTS = """
accounts AS (
  SELECT c.c_custkey AS account_id, c.c_name AS account_name, c.c_mktsegment AS tier,
         r.r_name AS region, n.n_name AS csm_owner
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

INVOICES = """
invoices AS (
  SELECT o_orderkey AS invoice_id, o_custkey AS account_id,
         CAST(o_orderdate AS DATE) AS invoice_date,
         CASE WHEN o_orderkey % 307 = 11 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END AS due_date,
         CASE WHEN o_orderkey % 401 = 13 THEN CAST(0 AS DECIMAL(18,2))
              WHEN o_orderkey % 409 = 17 THEN -CAST(o_totalprice AS DECIMAL(18,2))
              ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount_due,
         CASE WHEN o_orderkey % 211 = 5 THEN NULL
              WHEN o_orderkey % 20 = 0 THEN 'void'
              WHEN o_orderkey % 20 = 1 THEN 'written_off'
              WHEN CAST(o_orderdate AS DATE) < DATE '2001-02-01' AND o_orderkey % 11 <> 2 THEN 'paid'
              WHEN o_orderstatus = 'P' THEN 'partial'
              ELSE 'open' END AS status,
         CASE WHEN o_orderkey % 503 = 19 THEN NULL
              ELSE CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) END AS billing_period_start,
         last_day(CAST(o_orderdate AS DATE)) AS billing_period_end,
         o_orderpriority AS product_line
  FROM orders
)"""

PAYMENTS = """
payments AS (
  SELECT l_orderkey * 100 + l_linenumber AS payment_id, l_orderkey AS invoice_id,
         CAST(l_shipdate AS DATE) AS payment_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_paid,
         CASE WHEN l_linestatus = 'F' THEN 'wire' ELSE 'card' END AS payment_method
  FROM lineitem WHERE l_returnflag <> 'R'
)"""

CREDIT_MEMOS = """
credit_memos AS (
  SELECT l_orderkey * 100 + l_linenumber AS memo_id, l_orderkey AS invoice_id, CAST(l_shipdate AS DATE) AS memo_date,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS memo_amount,
         'RETURN' AS reason_code
  FROM lineitem WHERE l_returnflag = 'R'
)"""

CONTRACTS = """
contracts AS (
  SELECT c_custkey * 2 AS contract_id, c_custkey AS account_id,
         CASE WHEN c_custkey % 50 = 7 THEN CAST(0 AS DECIMAL(18,2))
              ELSE CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) * 20 AS DECIMAL(18,2)) END AS contracted_arr,
         CASE c_custkey % 3 WHEN 0 THEN 'annual' WHEN 1 THEN 'quarterly' ELSE 'monthly' END AS billing_frequency,
         CAST(DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS contract_start,
         CAST(DATE '2001-06-30' + CAST(c_custkey % 400 - 50 AS INTEGER) AS DATE) AS contract_end,
         c_custkey % 3 = 0 AS auto_renew
  FROM customer
  UNION ALL
  SELECT c_custkey * 2 + 1, c_custkey,
         CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) * 3 AS DECIMAL(18,2)),
         'monthly', DATE '2001-01-01', CAST(DATE '2001-06-30' + 90 AS DATE), FALSE
  FROM customer WHERE c_custkey % 97 = 5
)"""

BILLING = {
    "accounts": ACCOUNTS, "invoices": INVOICES, "payments": PAYMENTS,
    "credit_memos": CREDIT_MEMOS, "contracts": CONTRACTS,
}


def percent_sql(part: str, whole: str, digits: int) -> str:
    """``part`` of ``whole`` in percent, half up from the exact quotient, in whole cents."""
    n, d = f"CAST(({part}) * 100 AS HUGEINT)", f"NULLIF(CAST(({whole}) * 100 AS HUGEINT), 0)"
    units = f"(({200 * 10 ** digits} * ABS({n}) + ABS({d})) // (2 * ABS({d})))"
    return f"CAST(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -{units} ELSE {units} END AS DOUBLE) / {10 ** digits}"


def exceeds_sql(part: str, whole: str, percent: int) -> str:
    """Whether ``part`` is more than so many percent of ``whole``, without dividing."""
    return f"(({whole}) <> 0 AND ({part}) * 100 * SIGN({whole}) > {percent} * ABS({whole}))"


def with_ctes(names: list[str], body: str, extra: list[str] | None = None) -> str:
    parts = [BILLING[n] if n in BILLING else SERIES[n] for n in names]
    parts += extra or []
    return "WITH " + ",".join(parts) + "\n" + body


# ---------------------------------------------------------------- billing reports

# Open invoices per account, by age: sums that add up over accounts.
PER_ACCOUNT = f"""
per_account AS (
  SELECT account_id, COUNT(*) AS n, SUM(amount_due) AS owed, MAX(age) AS oldest,
         COALESCE(SUM(amount_due) FILTER (age > 0), 0) AS late, COALESCE(SUM(amount_due) FILTER (age > 0 AND age <= 30), 0) AS late_30,
         COALESCE(SUM(amount_due) FILTER (age > 30 AND age <= 60), 0) AS late_60, COALESCE(SUM(amount_due) FILTER (age > 90), 0) AS late_91
  FROM (SELECT account_id, amount_due, {AS_OF} - due_date AS age FROM invoices
        WHERE amount_due > 0 AND NOT list_contains(['paid', 'void', 'written_off'], status)) aged
  GROUP BY account_id
)"""

R1_BODY = """
SELECT account_name, tier, region, csm_owner, CAST(SUM(n) AS BIGINT) AS open_invoice_count, CAST(SUM(owed) AS DOUBLE) AS total_outstanding,
       CAST(SUM(late_30) AS DOUBLE) AS bucket_1_30, CAST(SUM(late_60) AS DOUBLE) AS bucket_31_60,
       CAST(SUM(late - late_30 - late_60 - late_91) AS DOUBLE) AS bucket_61_90, CAST(SUM(late_91) AS DOUBLE) AS bucket_90_plus,
       CAST(MAX(oldest) AS BIGINT) AS max_days_outstanding,
       CASE WHEN SUM(late_91) > 10000 THEN 'ESCALATE' WHEN SUM(late - late_30 - late_60) > 5000 THEN 'PRIORITY FOLLOW-UP' ELSE 'STANDARD' END
         AS collection_priority
FROM per_account JOIN accounts USING (account_id) GROUP BY ALL"""
R1 = with_ctes(["accounts", "invoices"], R1_BODY, [PER_ACCOUNT])

# What was billed, paid and credited as signed entries of one ledger, and its balance per live invoice.
LEDGER = """
ledger AS (
  SELECT invoice_id, amount_due AS billed, 0 AS paid, 0 AS credited, NULL AS paid_on, 0 AS is_payment FROM invoices
  UNION ALL BY NAME SELECT invoice_id, 0 AS billed, amount_paid AS paid, 0 AS credited, payment_date AS paid_on, 1 AS is_payment FROM payments
  UNION ALL BY NAME SELECT invoice_id, 0 AS billed, 0 AS paid, memo_amount AS credited, NULL AS paid_on, 0 AS is_payment FROM credit_memos
),
live AS (SELECT * FROM invoices WHERE NOT list_contains(['void', 'written_off'], status)),
balance AS (
  SELECT invoice_id, SUM(billed) - SUM(paid) - SUM(credited) AS net, SUM(paid) AS paid, SUM(credited) AS credited,
         CAST(SUM(is_payment) AS BIGINT) AS payments, MAX(paid_on) AS last_paid_on
  FROM ledger SEMI JOIN live USING (invoice_id) GROUP BY invoice_id
)"""

R2 = with_ctes(["accounts", "invoices", "payments", "credit_memos"], f"""
SELECT invoice_id, account_name, tier, product_line, invoice_date, due_date, CAST({AS_OF} - due_date AS BIGINT) AS days_past_due,
       CAST(net AS DOUBLE) AS net_balance_due, CAST(amount_due AS DOUBLE) AS amount_due, CAST(paid AS DOUBLE) AS total_paid,
       CAST(credited AS DOUBLE) AS credits_applied, {percent_sql("paid", "amount_due", 2)} AS pct_paid,
       payments AS payment_count, last_paid_on AS last_payment_date
FROM (FROM balance WHERE net > 0.01) owing JOIN live USING (invoice_id) JOIN accounts USING (account_id)
""", [LEDGER])

R3 = with_ctes(["accounts", "invoices"], """
SELECT account_name, tier, g.* EXCLUDE (account_id, total, least),
       CAST(total AS DOUBLE) AS total_billed, CAST(least AS DOUBLE) AS expected_charge,
       CAST(total - least AS DOUBLE) AS overcharge_amount
FROM (SELECT account_id, product_line, billing_period_start, billing_period_end, COUNT(*) AS duplicate_count,
             SUM(amount_due) AS total, MIN(amount_due) AS least,
             array_to_string(list_sort(list(invoice_id)), ', ') AS invoice_ids
      FROM invoices WHERE NOT list_contains(['void', 'written_off'], status)
      GROUP BY ALL HAVING COUNT(*) > 1) g
JOIN accounts USING (account_id)
""")

JUDGED = [f"""
this_year AS (
  SELECT account_id, SUM(amount_due) AS billed, CAST(COUNT(DISTINCT billing_period_start) AS BIGINT) AS periods
  FROM invoices WHERE NOT list_contains(['void', 'written_off'], status) AND invoice_date >= {YEAR_START} GROUP BY account_id
)""", f"""
judged AS (
  SELECT *, CASE WHEN {exceeds_sql("ABS(gap)", "contracted_arr", 5)} THEN 'REVIEW REQUIRED'
                 ELSE COALESCE(CASE SIGN(gap) WHEN 1 THEN 'OVER-BILLED' WHEN -1 THEN 'UNDER-BILLED' END, 'IN LINE') END AS billing_status,
         CASE WHEN NOT auto_renew AND contract_end - {AS_OF} <= 90 THEN 'RENEWAL RISK' END AS renewal_flag
  FROM (SELECT *, billed - contracted_arr AS gap
        FROM (FROM contracts WHERE contract_end >= {AS_OF}) going LEFT JOIN this_year USING (account_id)) compared
)"""]

R4 = with_ctes(["accounts", "invoices", "contracts"], f"""
SELECT account_name, tier, region, CAST(contracted_arr AS DOUBLE) AS contracted_arr, billing_frequency, contract_start,
       contract_end, CAST(billed AS DOUBLE) AS actual_arr_billed, periods AS periods_billed, CAST(gap AS DOUBLE) AS arr_variance,
       {percent_sql("gap", "contracted_arr", 2)} AS variance_pct, billing_status, renewal_flag
FROM judged JOIN accounts USING (account_id)
""", JUDGED)

# Contracts not ended, each with what its account was billed this year (0 where nothing was).
MEASURED = f"""
measured AS (
  SELECT contract_id, contracted_arr, COALESCE(billed, 0) AS billed, ABS(COALESCE(billed, 0) - contracted_arr) AS gap
  FROM (FROM contracts WHERE contract_end >= {AS_OF}) c LEFT JOIN (
    SELECT account_id, SUM(amount_due) AS billed FROM invoices
    WHERE invoice_date >= {YEAR_START} AND NOT list_contains(['void', 'written_off'], status) GROUP BY account_id) y USING (account_id)
)"""

# The four vectors: those of single invoices in one pass of filtered sums, one row with a pair for each vector.
VECTORS = [LEDGER, MEASURED, f"""
per_invoice AS (
  SELECT COUNT(*) FILTER (late) AS late_n, SUM(amount_due) FILTER (late) AS late_amount,
         COUNT(*) FILTER (short) AS short_n, SUM(amount_due - paid) FILTER (short) AS short_amount
  FROM (SELECT amount_due, paid, due_date < {AS_OF} AND status <> 'paid' AS late, paid > 0 AND paid < amount_due AS short
        FROM live JOIN balance USING (invoice_id)) judged
),
per_group AS (
  SELECT COUNT(*) AS n, SUM(excess) AS amount
  FROM (SELECT SUM(amount_due) - MIN(amount_due) AS excess FROM live
        GROUP BY account_id, product_line, billing_period_start, billing_period_end HAVING COUNT(*) > 1) groups
),
per_contract AS (SELECT COUNT(*) AS n, SUM(gap) AS amount FROM measured WHERE {exceeds_sql("gap", "contracted_arr", 2)}),
vectors AS (
  SELECT unnest([
    {{'leakage_type': 'Aging Receivables', 'description': 'Invoice unpaid past due date', 'n': i.late_n, 'amount': i.late_amount}},
    {{'leakage_type': 'Short Payments', 'description': 'Invoice partially paid — balance outstanding', 'n': i.short_n, 'amount': i.short_amount}},
    {{'leakage_type': 'Duplicate Charges', 'description': 'Same account billed twice for same period', 'n': g.n, 'amount': g.amount}},
    {{'leakage_type': 'Contract vs Billed Variance', 'description': 'Billing rate differs from signed contract', 'n': c.n, 'amount': c.amount}}
  ], recursive := true)
  FROM per_invoice i, per_group g, per_contract c
)"""]

R5 = with_ctes(["invoices", "payments", "credit_memos", "contracts"], f"""
SELECT leakage_type, description, n AS record_count, CAST(amount AS DOUBLE) AS amount_at_risk,
       {percent_sql("amount", "SUM(amount) OVER ()", 1)} AS pct_of_total_risk
FROM vectors
""", VECTORS)

# Payments with their invoice, and invoices that no payment names.
PAID_ROWS = """
paid_rows AS (
  SELECT invoice_id, account_id, amount_due, amount_paid, amount_due - amount_paid AS net FROM payments JOIN invoices USING (invoice_id)
  UNION ALL
  SELECT invoice_id, account_id, amount_due, NULL, amount_due FROM invoices ANTI JOIN payments USING (invoice_id)
)"""

R10 = with_ctes(["accounts", "invoices", "payments"], """
SELECT account_name, invoice_id, CAST(net AS DOUBLE) AS net_balance FROM (FROM paid_rows WHERE net > 0.01) r JOIN accounts USING (account_id)
""", [PAID_ROWS])

R11 = with_ctes(["invoices"], f"SELECT COUNT(*) FILTER (due_date < {AS_OF} - 90) AS d90 FROM invoices")

SERIES: dict[str, str] = {}

ORACLE: dict[str, str] = {
    "aging_receivables": R1,
    "payment_shortfall": R2,
    "duplicate_charges": R3,
    "contract_variance": R4,
    "leakage_summary": R5,
    "monthly_exceptions": R10,
    "aging_bucket_count": R11,
}


# ---------------------------------------------------------------- monthly series

_CUST_MONTH = """(SELECT o_custkey AS custkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month,
               SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
        FROM orders GROUP BY 1, 2)"""

SERIES.update({
    "series_nation": f"""
series AS (
  SELECT n.n_name AS account, cm.month, CAST(SUM(cm.amount) AS DOUBLE) AS revenue
  FROM {_CUST_MONTH} cm
  JOIN customer c ON cm.custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name, cm.month
)""",
    "series_customer": f"""
series AS (
  SELECT c.c_name AS account, cm.month, CAST(cm.amount AS DOUBLE) AS revenue
  FROM {_CUST_MONTH} cm JOIN customer c ON cm.custkey = c.c_custkey
)""",
    "metrics_nation": """
metrics AS (
  SELECT n.n_name AS account, CAST(date_trunc('month', CAST(o.o_orderdate AS DATE)) AS DATE) AS month,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
         CAST(COUNT(*) AS DOUBLE) AS orders,
         CAST(COALESCE(SUM(d.discount_given), 0) AS DOUBLE) AS discount_given
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)))
                    AS discount_given FROM lineitem GROUP BY l_orderkey) d ON o.o_orderkey = d.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2
)""",
})


def enriched_ctes(source: str = "series", where: str = "", prefix: str = "d_", out: str = "enriched") -> list[str]:
    """CTE chain of the detector over ``source(account, month, revenue)``; the
    intermediate CTEs are named ``<prefix>…`` and the last one ``out``."""
    w = "PARTITION BY account ORDER BY month NULLS LAST"
    ctes = [f"""
d_base AS (
  SELECT account, month, revenue,
         CASE WHEN COUNT(revenue) OVER w6 >= 5 THEN AVG(revenue) OVER w6 END AS rolling_mean,
         CASE WHEN COUNT(revenue) OVER w6 >= 5 THEN STDDEV_SAMP(revenue) OVER w6 END AS s,
         LAST_VALUE(revenue IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
  FROM {source} {where}
  WINDOW w6 AS ({w} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
)""", f"""
d_std AS (
  SELECT *, CASE WHEN s IS NOT NULL THEN greatest(s, rolling_mean * 0.03) END AS rolling_std,
         filled / NULLIF(LAG(filled, 6) OVER ({w}), 0) - 1 AS erosion_pct
  FROM d_base
)""", """
d_z AS (
  SELECT *, (revenue - rolling_mean) / NULLIF(rolling_std, 0) AS z_score,
         (revenue - rolling_mean) / NULLIF(rolling_mean, 0) * 100 AS pct_vs_baseline
  FROM d_std
)""", """
d_flag AS (
  SELECT *, COALESCE(abs(z_score) >= 2.5, FALSE) AS point_anomaly,
         COALESCE(erosion_pct <= -0.30, FALSE) AS erosion_flag
  FROM d_z
)""", """
d_type AS (
  SELECT *, CASE WHEN point_anomaly AND z_score > 0 THEN 'SPIKE'
                 WHEN point_anomaly AND z_score < 0 THEN 'DROP'
                 WHEN erosion_flag THEN 'EROSION' ELSE 'NORMAL' END AS anomaly_type
  FROM d_flag
)""", """
enriched AS (
  SELECT *, CASE WHEN anomaly_type = 'EROSION' THEN abs(erosion_pct) * 100
                 ELSE COALESCE(abs(z_score), 0) END AS severity_score
  FROM d_type
)"""]
    return [c.replace("d_", prefix).replace("enriched AS", f"{out} AS") for c in ctes]


REPORT_CTE = """
report AS (
  SELECT account, strftime(month, '%Y-%m') AS month, round_even(revenue, 2) AS revenue,
         round_even(rolling_mean, 2) AS rolling_mean, round_even(pct_vs_baseline, 1) AS pct_vs_baseline,
         round_even(z_score, 2) AS z_score, anomaly_type, round_even(severity_score, 2) AS severity_score,
         CASE WHEN anomaly_type = 'EROSION' THEN
                CASE WHEN round_even(severity_score, 2) >= 40 THEN 'HIGH'
                     WHEN round_even(severity_score, 2) >= 20 THEN 'MEDIUM' ELSE 'LOW' END
              ELSE CASE WHEN round_even(severity_score, 2) >= 10 THEN 'HIGH'
                        WHEN round_even(severity_score, 2) >= 4 THEN 'MEDIUM' ELSE 'LOW' END END AS priority
  FROM enriched WHERE anomaly_type <> 'NORMAL'
)"""


def _anomaly(series: str, body: str, report: bool = True) -> str:
    extra = enriched_ctes() + ([REPORT_CTE] if report else [])
    return with_ctes([series], body, extra)


R6 = _anomaly("series_nation", """
SELECT account, month, revenue, ROUND(rolling_mean, 6) AS rolling_mean, ROUND(rolling_std, 6) AS rolling_std,
       ROUND(z_score, 6) AS z_score, ROUND(pct_vs_baseline, 6) AS pct_vs_baseline, point_anomaly,
       ROUND(erosion_pct, 6) AS erosion_pct, erosion_flag, anomaly_type, ROUND(severity_score, 6) AS severity_score
FROM enriched""", report=False)

R7 = _anomaly("series_nation", "SELECT * FROM report")
R7_CUSTOMER = _anomaly("series_customer", "SELECT * FROM report")

R8_TYPE = _anomaly("series_nation", """
SELECT anomaly_type, COUNT(account) AS count, round_even(AVG(severity_score), 2) AS avg_severity,
       COUNT(DISTINCT account) AS accounts_affected
FROM report GROUP BY anomaly_type""")

R8_PRIORITY = _anomaly("series_nation", """
SELECT p.priority, COALESCE(c.n, 0) AS count
FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) p(priority)
LEFT JOIN (SELECT priority, COUNT(*) AS n FROM report GROUP BY priority) c ON p.priority = c.priority""")

R8_HEADLINE = _anomaly("series_nation", """
SELECT (SELECT COUNT(DISTINCT account) FROM series) AS accounts_analyzed,
       (SELECT COUNT(DISTINCT month) FROM series) AS months_analyzed,
       (SELECT COUNT(*) FROM report) AS anomalies_flagged,
       (SELECT COUNT(DISTINCT account) FROM report WHERE priority = 'HIGH') AS high_priority_accounts""")

R8_TOP15 = _anomaly("series_nation", """
SELECT r.* FROM report r JOIN (
  SELECT account, strftime(month, '%Y-%m') AS month FROM enriched WHERE anomaly_type <> 'NORMAL'
  ORDER BY severity_score DESC, account, month LIMIT 15) t ON r.account = t.account AND r.month = t.month""")

R9 = _anomaly("series_nation", """
SELECT account, month, revenue, ROUND(rolling_mean, 6) AS rolling_mean, anomaly_type,
       anomaly_type <> 'NORMAL' AS flagged
FROM enriched
WHERE account IN (SELECT account FROM (
        SELECT account, MAX(severity_score) AS worst FROM enriched WHERE anomaly_type <> 'NORMAL'
        GROUP BY account ORDER BY worst DESC, account LIMIT 4))""", report=False)

J11 = with_ctes(["series_nation"], """
SELECT c.* FROM cur c
WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.account = c.account AND p.month = c.month
                  AND p.anomaly_type = c.anomaly_type)""",
    enriched_ctes(prefix="c_", out="cur_enriched")
    + enriched_ctes(where="WHERE month < DATE '2001-06-01'", prefix="p_", out="prev_enriched")
    + [REPORT_CTE.replace("report AS", "cur AS").replace("FROM enriched", "FROM cur_enriched"),
       REPORT_CTE.replace("report AS", "prev AS").replace("FROM enriched", "FROM prev_enriched")])


def baseline_sql(metric: str) -> str:
    """Baseline and spread of a full window ``w``; of equal values they are the value and 0, exactly."""
    flat = f"MIN({metric}) OVER w = MAX({metric}) OVER w"
    return (f"CASE WHEN COUNT({metric}) OVER w >= 6 THEN CASE WHEN {flat} THEN MIN({metric}) OVER w ELSE AVG({metric}) OVER w END END AS baseline, "
            f"CASE WHEN COUNT({metric}) OVER w >= 6 THEN CASE WHEN {flat} THEN 0 ELSE STDDEV_SAMP({metric}) OVER w END END AS spread")


def _strict(source: str, metric: str, keys: str) -> str:
    part = f"PARTITION BY {keys} ORDER BY month" if keys else "ORDER BY month"
    return f"""
SELECT *, {baseline_sql(metric)}
FROM {source}
WINDOW w AS ({part} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"""


def _flag_pred(x: str, base: str, spread: str, z: str = "2.5") -> str:
    return (f"COALESCE(CASE WHEN {spread} > 0 THEN abs({x} - {base}) / {spread} >= {z} "
            f"WHEN {spread} = 0 THEN {x} <> {base} "
            f"ELSE FALSE END, FALSE)")


W10 = with_ctes(["series_nation"], f"""
SELECT account, month, revenue, ROUND(baseline, 6) AS baseline, ROUND(spread, 6) AS spread
FROM ({_strict('series', 'revenue', 'account')}) b""")

U2 = with_ctes(["metrics_nation"], f"""
SELECT account, month, revenue, orders, discount_given
FROM ({_strict('metrics', 'revenue', 'account')}) b
WHERE {_flag_pred('revenue', 'baseline', 'spread')}""")

U3 = with_ctes(["metrics_nation"], f"""
SELECT account, month, metric, value
FROM ({_strict('''(SELECT account, month, 'revenue' AS metric, revenue AS value FROM metrics
                   UNION ALL SELECT account, month, 'orders', orders FROM metrics
                   UNION ALL SELECT account, month, 'discount_given', discount_given FROM metrics)''',
               'value', 'account, metric')}) b
WHERE {_flag_pred('value', 'baseline', 'spread')}""")

W11 = with_ctes(["series_customer"], f"""
SELECT account, month, revenue, ROUND(baseline, 6) AS baseline,
       ROUND((revenue - baseline) / NULLIF(fl, 0), 6) AS z
FROM (SELECT *, CASE WHEN spread IS NOT NULL THEN greatest(spread, baseline * 0.03) END AS fl
      FROM ({_strict('series', 'revenue', 'account')}) b) f
WHERE {_flag_pred('revenue', 'baseline', 'fl')}""")

ORACLE.update({
    "anomaly_series": R6,
    "anomaly_report": R7,
    "anomaly_report_customer": R7_CUSTOMER,
    "anomaly_summary_by_type": R8_TYPE,
    "anomaly_priority_counts": R8_PRIORITY,
    "anomaly_headline": R8_HEADLINE,
    "top15_report": R8_TOP15,
    "top_account_chart_feed": R9,
    "anti_new_findings": J11,
    "baseline_strict": W10,
    "metric_flag": U2,
    "multi_metric_pulse": U3,
    "baseline_floor_strict": W11,
})


# ---------------------------------------------------------------- pattern tagging

def _patterns_cte() -> str:
    from .sources.patterns import DEFAULT_PATTERNS

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(f"({i + 1}, {q(n)}, {q(c)}, {q(k)})" for i, (n, c, k) in enumerate(DEFAULT_PATTERNS))
    return f"\npatterns(ordinal, name, company, category) AS (VALUES {rows})"


def _tag_sql(table: str, id_col: str, text_col: str) -> str:
    return f"""WITH {_patterns_cte()},
m AS (SELECT t.{id_col} AS id, MIN(p.ordinal) AS ord
      FROM {table} t JOIN patterns p ON contains(lower(t.{text_col}), lower(p.name)) GROUP BY t.{id_col})
SELECT t.{id_col} AS id, m.ord IS NOT NULL AS blocked, COALESCE(p.name, '') AS pattern,
       CASE WHEN m.ord IS NOT NULL THEN COALESCE(p.category, 'unknown') END AS category
FROM {table} t LEFT JOIN m ON t.{id_col} = m.id LEFT JOIN patterns p ON p.ordinal = m.ord"""


R12_PAGES = _tag_sql("pages", "page_id", "html")
R12_DOCS = _tag_sql("documents", "doc_id", "text")


def _category_stats_sql(source: str) -> str:
    return f"""
SELECT CASE WHEN GROUPING(category) = 1 THEN 'TOTAL' ELSE category END AS category, COUNT(*) AS count
FROM (SELECT COALESCE(category, 'unknown') AS category FROM {source}) s
GROUP BY ROLLUP (category)"""


A16_HITS = f"""WITH tagged AS ({R12_PAGES})
{_category_stats_sql("(SELECT * FROM tagged WHERE blocked)")}"""

J8 = f"""WITH {_patterns_cte()},
inc AS (SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS name, page_id AS o FROM pages),
firsts AS (SELECT name, o FROM (
             SELECT name, o, ROW_NUMBER() OVER (PARTITION BY lower(name) ORDER BY o, name) AS rn
             FROM inc WHERE name <> '') x WHERE rn = 1),
fresh AS (SELECT * FROM firsts WHERE lower(name) NOT IN (SELECT lower(name) FROM patterns)),
extended AS (
  SELECT ordinal, name, company, category FROM patterns
  UNION ALL
  SELECT CAST((SELECT MAX(ordinal) FROM patterns) + ROW_NUMBER() OVER (ORDER BY o, name) AS INTEGER),
         name, 'unknown', 'ai' FROM fresh)"""

ORACLE.update({
    "pattern_tagging": R12_PAGES,
    "pattern_tagging_documents": R12_DOCS,
    "pattern_hits_by_category": A16_HITS,
    "anti_append_new": J8 + "\nSELECT CAST(ordinal AS BIGINT) AS ordinal, name, company, category FROM extended",
    "agg_category_stats": J8 + _category_stats_sql("extended"),
})

ORACLE["pattern_tagging_extended"] = J8 + """,
m AS (SELECT t.page_id AS id, MIN(p.ordinal) AS ord
      FROM pages t JOIN extended p ON contains(lower(t.html), lower(p.name)) GROUP BY t.page_id)
SELECT t.page_id AS id, m.ord IS NOT NULL AS blocked, COALESCE(p.name, '') AS pattern,
       CASE WHEN m.ord IS NOT NULL THEN COALESCE(p.category, 'unknown') END AS category
FROM pages t LEFT JOIN m ON t.page_id = m.id LEFT JOIN extended p ON p.ordinal = m.ord"""

ORACLE["duplicate_charges_paged"] = with_ctes(["invoices"], """
SELECT account_id, product_line, billing_period_start, billing_period_end, CAST((place - 1) // 2 AS BIGINT) AS page, COUNT(*) AS n_ids,
       string_agg(CAST(invoice_id AS VARCHAR), ', ' ORDER BY invoice_id) AS invoice_ids
FROM (SELECT *, COUNT(*) OVER grp AS members, ROW_NUMBER() OVER (grp ORDER BY invoice_id) AS place
      FROM invoices WHERE status NOT IN ('void', 'written_off')
      WINDOW grp AS (PARTITION BY account_id, product_line, billing_period_start, billing_period_end)) x
WHERE members > 1 GROUP BY 1, 2, 3, 4, 5""")

ORACLE["pattern_tagging_index"] = """
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS name FROM benchmark),
list AS (SELECT ROW_NUMBER() OVER (ORDER BY length(name) DESC, name) AS ordinal, name FROM words),
m AS (SELECT d.doc_id AS id, MIN(l.ordinal) AS ord FROM documents d JOIN list l ON contains(lower(d.text), l.name) GROUP BY d.doc_id)
SELECT d.doc_id AS id, m.ord IS NOT NULL AS blocked, COALESCE(l.name, '') AS pattern, 'len' || length(l.name) AS category
FROM documents d LEFT JOIN m ON d.doc_id = m.id LEFT JOIN list l ON l.ordinal = m.ord"""


# ---------------------------------------------------------------- freight

FREIGHT = """
fi AS (
  SELECT l.l_orderkey AS invoice_id, l.l_linenumber AS line_no, l.l_suppkey AS account_id,
         'C' || CAST(l.l_suppkey % 10 AS VARCHAR) AS carrier, p.p_brand AS lane,
         CASE WHEN p.p_size > 45 THEN 'AIR' ELSE 'OCEAN' END AS mode,
         CASE WHEN p.p_size > 45 THEN 'AIR' WHEN p.p_size <= 15 THEN 'LCL'
              WHEN p.p_size <= 30 THEN 'FCL 20''' ELSE 'FCL 40''' END AS container,
         CAST(l.l_quantity AS DECIMAL(18,2)) AS qty, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS billed,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_extendedprice AS DECIMAL(18,2))
              ELSE CAST(FLOOR(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))))
                        AS DECIMAL(18,2)) END AS paid,
         CAST(l.l_shipdate AS DATE) AS arrived,
         CAST(CAST(l.l_shipdate AS DATE) + CAST(l.l_partkey % 15 AS INTEGER) AS DATE) AS delivered
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
basis AS (
  SELECT carrier, lane, container, CAST(FLOOR((MIN(u) + MAX(u)) / 2) AS DECIMAL(18,2)) AS rate
  FROM (SELECT *, FLOOR(CAST(billed AS DOUBLE) / NULLIF(CAST(qty AS DOUBLE), 0)) AS u FROM fi) x
  GROUP BY carrier, lane, container
),
contract_rates AS (
  SELECT carrier, lane, container, rate, 1 AS ordinal FROM basis
  WHERE (CAST(substr(carrier, 2) AS INTEGER) + length(lane)) % 4 <> 0
  UNION ALL
  SELECT carrier, lane, container, CAST(rate + 1 AS DECIMAL(18,2)), 2 FROM basis
  WHERE (CAST(substr(carrier, 2) AS INTEGER) + length(lane)) % 4 <> 0 AND carrier = 'C3'
),
spot_quotes AS (
  SELECT carrier, lane, container, CAST(FLOOR(rate * 1.1) AS DECIMAL(18,2)) AS rate, 1 AS ordinal FROM basis
  WHERE CAST(substr(carrier, 2) AS INTEGER) % 2 = 0
),
rules AS (
  SELECT s_suppkey AS account_id, CASE WHEN s_suppkey % 2 = 0 THEN 'flat' ELSE 'pct' END AS kind,
         CAST(CASE WHEN s_suppkey % 2 = 0 THEN
                CASE s_suppkey % 5 WHEN 0 THEN 0.01 WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 50 ELSE 100 END
              ELSE CASE s_suppkey % 3 WHEN 0 THEN 0.02 WHEN 1 THEN 0.05 ELSE 0.10 END END AS DECIMAL(18,4))
           AS tolerance,
         CAST(3 + s_suppkey % 5 AS INTEGER) AS free_days,
         CAST(75 + 25 * (s_suppkey % 4) AS DECIMAL(18,2)) AS day_rate
  FROM supplier
),
cr AS (SELECT carrier, lane, container, rate AS contract_rate FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY carrier, lane, container ORDER BY ordinal, rate) AS rn
         FROM contract_rates) x WHERE rn = 1),
sq AS (SELECT carrier, lane, container, rate AS spot_rate FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY carrier, lane, container ORDER BY ordinal, rate) AS rn
         FROM spot_quotes) x WHERE rn = 1),
f_lines AS (
  SELECT fi.*, COALESCE(cr.contract_rate, sq.spot_rate) AS rate,
         CASE WHEN cr.contract_rate IS NOT NULL THEN 'CONTRACT' WHEN sq.spot_rate IS NOT NULL THEN 'SPOT'
              ELSE 'NONE' END AS rate_source,
         CAST(COALESCE(cr.contract_rate, sq.spot_rate) * fi.qty AS DECIMAL(18,2)) AS expected,
         r.kind, r.tolerance, r.free_days, r.day_rate
  FROM fi LEFT JOIN cr ON fi.carrier = cr.carrier AND fi.lane = cr.lane AND fi.container = cr.container
          LEFT JOIN sq ON fi.carrier = sq.carrier AND fi.lane = sq.lane AND fi.container = sq.container
          LEFT JOIN rules r ON fi.account_id = r.account_id
),
f_lab AS (
  SELECT *, CASE WHEN rate IS NULL THEN 'RATE NOT ON FILE'
                 WHEN abs(billed - expected) <= CASE WHEN kind = 'flat' THEN tolerance ELSE expected * tolerance END
                   THEN 'WITHIN TOLERANCE'
                 WHEN billed - expected > 0 THEN 'OVERCHARGE' ELSE 'UNDERBILL' END AS audit_label,
         CAST(COALESCE(greatest((delivered - arrived) - free_days, 0) * day_rate, 0) AS DECIMAL(18,2)) AS demurrage
  FROM f_lines
),
audit AS (
  SELECT *, approved - paid AS balance,
         CASE WHEN approved - paid > 0 AND paid > 0 THEN 'SHORT PAY: ' || audit_label
              WHEN approved - paid > 0 THEN 'BALANCE DUE: ' || audit_label END AS pay_status
  FROM (SELECT *, CASE WHEN audit_label = 'OVERCHARGE' THEN expected ELSE billed END AS approved FROM f_lab) a
)"""

R13 = "WITH " + FREIGHT + """
SELECT invoice_id, CAST(line_no AS BIGINT) AS line_no, account_id, carrier, lane, mode, container, rate_source,
       CAST(billed AS DOUBLE) AS billed, CAST(expected AS DOUBLE) AS expected, CAST(paid AS DOUBLE) AS paid,
       CAST(balance AS DOUBLE) AS balance, CAST(demurrage AS DOUBLE) AS demurrage, audit_label, pay_status
FROM audit WHERE audit_label <> 'WITHIN TOLERANCE' OR pay_status IS NOT NULL"""

R14 = "WITH " + FREIGHT + """
SELECT CASE GROUPING(carrier, mode, container, account_id) WHEN 15 THEN 'TOTAL' WHEN 7 THEN 'CARRIER'
            WHEN 9 THEN 'MODE_CONTAINER' ELSE 'ACCOUNT' END AS level,
       carrier, mode, container, account_id, COUNT(*) AS lines, CAST(SUM(exc) AS BIGINT) AS exceptions,
       ROUND(SUM(exc) / COUNT(*) * 1e6, 0) / 1e6 AS exception_rate,
       CAST(SUM(billed) AS DOUBLE) AS billed_total, CAST(SUM(over_amt) AS DOUBLE) AS overcharge_total,
       CAST(SUM(demurrage) AS DOUBLE) AS demurrage_total
FROM (SELECT carrier, mode, container, account_id, billed, demurrage,
             CASE WHEN audit_label <> 'WITHIN TOLERANCE' OR pay_status IS NOT NULL THEN 1 ELSE 0 END AS exc,
             CASE WHEN audit_label = 'OVERCHARGE' THEN billed - expected ELSE 0 END AS over_amt
      FROM audit) x
GROUP BY GROUPING SETS ((), (carrier), (mode, container), (account_id))"""

J10 = "WITH " + FREIGHT + """
SELECT invoice_id, CAST(line_no AS BIGINT) AS line_no, carrier, lane, mode, container, CAST(rate AS DOUBLE) AS rate,
       rate_source, CAST(expected AS DOUBLE) AS expected FROM audit"""

# ---------------------------------------------------------------- recovery

RECOVERY = """
rl AS (
  SELECT CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS month,
         CASE l_linenumber % 6 WHEN 0 THEN 'rate_error' WHEN 1 THEN 'duplicate_billing' WHEN 2 THEN 'accessorial'
              WHEN 3 THEN 'weight_class' WHEN 4 THEN 'fuel_surcharge' ELSE 'address_correction' END AS error_type,
         CASE l_returnflag WHEN 'A' THEN 'PRE' WHEN 'R' THEN 'POST' ELSE 'LEAKED' END AS channel,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS amount
  FROM lineitem
),
dash AS (
  SELECT CASE WHEN fy = 1 THEN 'FY' ELSE strftime(month, '%Y-%m') END AS period, errors,
         CAST(pool AS DOUBLE) AS pool, CAST(avoided AS DOUBLE) AS avoided, CAST(recovered AS DOUBLE) AS recovered,
         CAST(pool - avoided - recovered AS DOUBLE) AS leakage,
         CAST(avoided AS DOUBLE) / NULLIF(CAST(pool AS DOUBLE), 0) AS catch_rate,
         CAST(recovered AS DOUBLE) * 0.28 AS post_cost,
         CAST(avoided AS DOUBLE) * PRE_RATE AS pre_cost,
         ((CAST(recovered AS DOUBLE) * 0.28) / NULLIF(CAST(recovered AS DOUBLE), 0))
           / NULLIF((CAST(avoided AS DOUBLE) * PRE_RATE) / NULLIF(CAST(avoided AS DOUBLE), 0), 0) AS cost_multiple
  FROM (SELECT month, GROUPING(month) AS fy, COUNT(*) AS errors, SUM(amount) AS pool,
               SUM(CASE WHEN channel = 'PRE' THEN amount ELSE 0 END) AS avoided,
               SUM(CASE WHEN channel = 'POST' THEN amount ELSE 0 END) AS recovered
        FROM rl GROUP BY ROLLUP (month)) g
)""".replace("PRE_RATE", repr(0.28 / 6.5))

R15 = "WITH " + RECOVERY + "\nSELECT * FROM dash"

_TYPES = ("rate_error", "duplicate_billing", "accessorial", "weight_class", "fuel_surcharge", "address_correction")


def _matrix(types) -> str:
    named = "".join(f",\n       CAST(SUM(CASE WHEN error_type = '{t}' THEN amount END) AS DOUBLE) AS {t}" for t in types)
    listed = ", ".join(f"'{t}'" for t in types)
    return "WITH " + RECOVERY + f"""
SELECT month{named},
       CAST(SUM(CASE WHEN error_type IS NULL OR error_type NOT IN ({listed}) THEN amount END) AS DOUBLE) AS other
FROM rl GROUP BY month"""


A19 = _matrix(_TYPES)
A19_FOUND = _matrix(sorted(_TYPES)[:4])

_CUBE = "WITH " + RECOVERY + """,
rate AS (SELECT CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS month, (4 + COUNT(*) % 3) / 100.0 AS pre, (25 + COUNT(*) % 7) / 100.0 AS post
         FROM lineitem GROUP BY 1),
cell AS (SELECT month, error_type, COUNT(*) AS errors, SUM(amount) AS pool, COALESCE(SUM(amount) FILTER (channel = 'PRE'), 0) AS avoided,
                COALESCE(SUM(amount) FILTER (channel = 'POST'), 0) AS recovered FROM rl GROUP BY ALL),
sums AS (SELECT 2 * GROUPING(c.month) + GROUPING(error_type) AS level, c.month, error_type, SUM(errors) AS errors, SUM(pool) AS pool,
                SUM(avoided) AS avoided, SUM(recovered) AS recovered,
                CAST(SUM(CAST(avoided AS DECIMAL(24,4)) * CAST(pre AS DECIMAL(6,4))) AS DOUBLE) AS pre_cost,
                CAST(SUM(CAST(recovered AS DECIMAL(24,4)) * CAST(post AS DECIMAL(6,4))) AS DOUBLE) AS post_cost
         FROM cell c JOIN rate ON rate.month = c.month GROUP BY CUBE (c.month, error_type)),
shown AS (SELECT CAST(level AS BIGINT) AS level, CASE WHEN level >= 2 THEN 'FY' ELSE strftime(month, '%Y-%m') END AS period,
                 CASE WHEN level % 2 = 1 THEN 'ALL' ELSE error_type END AS error_type, CAST(errors AS BIGINT) AS errors,
                 CAST(pool AS DOUBLE) AS pool, CAST(avoided AS DOUBLE) AS avoided, CAST(recovered AS DOUBLE) AS recovered,
                 CAST(pool - avoided - recovered AS DOUBLE) AS leakage, CAST(avoided AS DOUBLE) / NULLIF(CAST(pool AS DOUBLE), 0) AS catch_rate,
                 pre_cost, post_cost,
                 (post_cost / NULLIF(CAST(recovered AS DOUBLE), 0)) / NULLIF(pre_cost / NULLIF(CAST(avoided AS DOUBLE), 0), 0) AS cost_multiple
          FROM sums)
"""
R15_TYPES = _CUBE + "SELECT * FROM shown"
R15_CATCH = _CUBE + "SELECT error_type, catch_rate, leakage, cost_multiple FROM shown WHERE level = 2"

R16 = "WITH " + RECOVERY + f"""
SELECT period, catch_rate, pool
FROM ({_strict("(SELECT period, catch_rate, pool FROM dash WHERE period <> 'FY')", 'catch_rate', '')
       .replace('ORDER BY month', 'ORDER BY period')}) b
WHERE {_flag_pred('catch_rate', 'baseline', 'spread')}"""

ORACLE.update({
    "freight_exception_report": R13,
    "freight_dashboard": R14,
    "lookup_rate_composite": J10,
    "recovery_dashboard": R15,
    "pivot_error_month": A19,
    "pivot_error_month_found": A19_FOUND,
    "recovery_by_type": R15_TYPES,
    "recovery_catch_by_type": R15_CATCH,
    "catch_rate_flag": R16,
})


# ---------------------------------------------------------------- sources and sinks

# Columns of the billing tables by kind: n number, d date, s string, b boolean.
_PROFILED = {
    "accounts": "account_id:n account_name:s tier:s region:s csm_owner:s",
    "invoices": "invoice_id:n account_id:n invoice_date:d due_date:d amount_due:n status:s billing_period_start:d "
                "billing_period_end:d product_line:s",
    "payments": "payment_id:n invoice_id:n payment_date:d amount_paid:n payment_method:s",
    "contracts": "contract_id:n account_id:n contracted_arr:n billing_frequency:s contract_start:d contract_end:d auto_renew:b",
    "credit_memos": "memo_id:n invoice_id:n memo_date:d memo_amount:n reason_code:s",
}


def _profile_sql(table: str, column: str, kind: str) -> str:
    number = {"d": f"CAST({column} AS DATE) - DATE '1970-01-01'", "s": f"length({column})", "b": f"CAST({column} AS INTEGER)"}.get(kind, column)
    text = column if kind == "s" else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({column}) AS null_count,
       COUNT(DISTINCT {column}) AS distinct_count, CAST(SUM(CAST({number} AS DECIMAL(20,4))) AS DOUBLE) AS total,
       CAST(MIN({number}) AS DOUBLE) AS least, CAST(MAX({number}) AS DOUBLE) AS greatest, MIN({text}) AS first_text, MAX({text}) AS last_text
FROM {table}"""


IO1 = with_ctes(["accounts", "invoices", "payments", "contracts", "credit_memos"], "\nUNION ALL ".join(
    _profile_sql(t, *c.split(":")) for t, columns in _PROFILED.items() for c in columns.split()))

IO2 = with_ctes(["series_nation"], "SELECT * FROM series")

IO4 = with_ctes(["invoices"], """
SELECT invoice_id, CAST(billing_amount AS DOUBLE) AS billing_amount, CAST(orders_amount AS DOUBLE) AS orders_amount,
       CAST(billing_amount - orders_amount AS DOUBLE) AS difference,
       CASE WHEN n_o = 0 THEN 'ONLY_IN_BILLING' WHEN n_b = 0 THEN 'ONLY_IN_ORDERS'
            WHEN abs(billing_amount - orders_amount) <= 0.01 THEN 'MATCHED' ELSE 'AMOUNT_MISMATCH' END AS status
FROM (SELECT invoice_id, SUM(CASE WHEN src = 'billing' THEN amount END) AS billing_amount,
             SUM(CASE WHEN src = 'orders' THEN amount END) AS orders_amount,
             COUNT(CASE WHEN src = 'billing' THEN 1 END) AS n_b, COUNT(CASE WHEN src = 'orders' THEN 1 END) AS n_o
      FROM (SELECT 'billing' AS src, invoice_id, amount_due AS amount FROM invoices
            UNION ALL
            SELECT 'orders', l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                                         * (1 + CAST(l_tax AS DECIMAL(4,2))) FROM lineitem) m
      GROUP BY invoice_id) g""")

IO4_ALL = with_ctes(["invoices", "payments"], """
, b AS (SELECT invoice_id, CAST(SUM(amount_due) AS DECIMAL(30,6)) AS amount FROM invoices GROUP BY invoice_id),
o AS (SELECT l_orderkey AS invoice_id, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                                                * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DECIMAL(30,6)) AS amount FROM lineitem GROUP BY l_orderkey),
p AS (SELECT invoice_id, CAST(SUM(amount_paid) AS DECIMAL(30,6)) AS amount FROM payments GROUP BY invoice_id),
sides AS (SELECT invoice_id, b.invoice_id IS NULL AS no_b, o.invoice_id IS NULL AS no_o, p.invoice_id IS NULL AS no_p,
                 b.amount AS ba, o.amount AS oa, p.amount AS pa
          FROM b FULL JOIN o USING (invoice_id) FULL JOIN p USING (invoice_id))
SELECT invoice_id, CAST(ba AS DOUBLE) AS billing_amount, CAST(oa AS DOUBLE) AS orders_amount, CAST(pa AS DOUBLE) AS payments_amount,
       CAST(greatest(ba, oa, pa) - least(ba, oa, pa) AS DOUBLE) AS spread,
       concat_ws(',', CASE WHEN no_b THEN 'billing' END, CASE WHEN no_o THEN 'orders' END, CASE WHEN no_p THEN 'payments' END) AS missing_in,
       CASE WHEN no_b OR no_o OR no_p THEN 'INCOMPLETE'
            WHEN greatest(ba, oa, pa) - least(ba, oa, pa) <= 0.01 THEN 'MATCHED' ELSE 'AMOUNT_MISMATCH' END AS status
FROM sides""")

ORACLE.update({
    "scan_billing": IO1,
    "scan_monthly_revenue": IO2,
    "sink_report_csv": R7,
    "multi_source_merge": IO4,
    "multi_source_reconcile": IO4_ALL,
})

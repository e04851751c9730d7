"""File sources and sinks: the monthly revenue CSV, report CSV output, and
merging tables from several platforms.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_RAW_SERIES = T.StructType([
    T.StructField("account", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("revenue", T.DoubleType()),
])


def read_monthly_revenue(spark: SparkSession, path: str, month_format: str | None = None) -> DataFrame:
    """Read ``account, month, revenue`` CSV files (header row) with an
    explicit schema and parse ``month`` to a DATE (IO2). Row order is not
    kept: the detector orders inside its window. NaN revenue becomes NULL so
    comparisons behave like pandas' (NaN never flags)."""
    raw = spark.read.schema(_RAW_SERIES).option("header", True).csv(path)
    month = F.to_date("month", month_format) if month_format else F.to_date("month")
    rev = F.when(F.isnan("revenue"), F.lit(None).cast("double")).otherwise(F.col("revenue"))
    return raw.select("account", month.alias("month"), rev.alias("revenue"))


def write_report_csv(report: DataFrame, path: str) -> None:
    """Write a report as CSV with a header, overwriting (IO3). One write of
    the final frame; parts are written in parallel, in report order."""
    report.write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def merge_sources(sources: Mapping[str, DataFrame], source_col: str = "source") -> DataFrame:
    """Stack tables from several platforms into one view, tagged with their
    source; columns missing on one side become NULL (IO4)."""
    tagged = [df.withColumn(source_col, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def reconcile(left: DataFrame, right: DataFrame, key: str, amount: str,
              left_name: str = "a", right_name: str = "b", tolerance: str = "0.01") -> DataFrame:
    """Reconcile per-key amounts of two platforms: MATCHED (within the
    tolerance), AMOUNT_MISMATCH, ONLY_IN_<left>, ONLY_IN_<right>.

    Plan: tag and stack both sides (``merge_sources``) and aggregate once per
    key with conditional sums — one exchange, partial aggregation on both
    sides, and the semantics of a full outer join of the two aggregates.
    """
    la, ra = f"{left_name}_{amount}", f"{right_name}_{amount}"
    merged = merge_sources({left_name: left.select(key, amount), right_name: right.select(key, amount)}, "_src")
    on_left, on_right = F.col("_src") == left_name, F.col("_src") == right_name
    per_key = merged.groupBy(key).agg(
        F.sum(F.when(on_left, F.col(amount))).alias(la),
        F.sum(F.when(on_right, F.col(amount))).alias(ra),
        F.count(F.when(on_left, F.lit(1))).alias("_nl"),
        F.count(F.when(on_right, F.lit(1))).alias("_nr"),
    )
    diff = F.col(la) - F.col(ra)
    status = (
        F.when(F.col("_nr") == 0, F.lit(f"ONLY_IN_{left_name.upper()}"))
        .when(F.col("_nl") == 0, F.lit(f"ONLY_IN_{right_name.upper()}"))
        .when(F.abs(diff) <= F.lit(Decimal(tolerance)), F.lit("MATCHED"))
        .otherwise(F.lit("AMOUNT_MISMATCH"))
    )
    return per_key.select(key, la, ra, diff.alias("difference"), status.alias("status"))


def reconcile_all(sources: Mapping[str, DataFrame], key: str, amount: str, tolerance: str = "0.01") -> DataFrame:
    """Reconcile per-key amounts of two or more platforms.

    Per key: each platform's amount, ``spread`` (largest less smallest),
    ``missing_in`` (names of the platforms without the key, in the given order)
    and ``status``: INCOMPLETE where a platform lacks the key, else MATCHED
    within the tolerance, else AMOUNT_MISMATCH. A key whose amounts on a
    platform are all NULL is there without an amount: a mismatch. NULL keys form
    one key. One exchange, as in ``reconcile``, however many platforms.
    """
    if len(sources) < 2:
        raise ValueError("reconciliation needs two platforms or more")
    merged = merge_sources({n: df.select(key, amount) for n, df in sources.items()}, "_src")
    per_key = merged.groupBy(key).agg(
        *[F.sum(F.when(F.col("_src") == n, F.col(amount))).alias(f"{n}_{amount}") for n in sources],
        *[F.count(F.when(F.col("_src") == n, F.lit(1))).alias(f"_n_{n}") for n in sources],
    )
    amounts = [F.col(f"{n}_{amount}") for n in sources]
    spread = F.greatest(*amounts) - F.least(*amounts)
    missing = F.concat_ws(",", *[F.when(F.col(f"_n_{n}") == 0, F.lit(n)) for n in sources])
    known = reduce(lambda a, b: a & b, [a.isNotNull() for a in amounts])
    status = (
        F.when(missing != "", F.lit("INCOMPLETE"))
        .when(known & (spread <= F.lit(Decimal(tolerance))), F.lit("MATCHED"))
        .otherwise(F.lit("AMOUNT_MISMATCH"))
    )
    return per_key.select(key, *amounts, spread.alias("spread"), missing.alias("missing_in"), status.alias("status"))


_BILLING_SCHEMAS = {
    "accounts": "ACCOUNTS", "invoices": "INVOICES", "payments": "PAYMENTS",
    "contracts": "CONTRACTS", "credit_memos": "CREDIT_MEMOS",
}


class BillingTables:
    """The five billing tables read from ``base_path/<table>`` with their
    declared schemas (no inference); each is read on first use."""

    def __init__(self, spark: SparkSession, base_path: str, fmt: str = "parquet"):
        self._spark, self._base, self._fmt = spark, base_path.rstrip("/"), fmt

    def _read(self, name: str) -> DataFrame:
        from . import schemas

        schema = getattr(schemas, _BILLING_SCHEMAS[name])
        reader = self._spark.read.schema(schema)
        if self._fmt == "csv":
            reader = reader.option("header", True)
        df = reader.format(self._fmt).load(f"{self._base}/{name}")
        return df.select(*schema.fieldNames())

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _BILLING_SCHEMAS:
            raise AttributeError(name)
        df = self._read(name)
        setattr(self, name, df)
        return df


def read_billing_tables(spark: SparkSession, base_path: str, fmt: str = "parquet") -> BillingTables:
    """Billing tables kept as ``<base_path>/accounts``, ``/invoices``,
    ``/payments``, ``/contracts``, ``/credit_memos`` (parquet, or CSV with a
    header); the reports in ``ledgerlens.plans.billing`` take them as they
    take the adapted tables."""
    return BillingTables(spark, base_path, fmt)


def write_billing_tables(tables, base_path: str) -> None:
    """Write the five billing tables of ``tables`` as parquet under ``base_path``."""
    for name in _BILLING_SCHEMAS:
        getattr(tables, name).write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/{name}")


def column_profile(df: DataFrame, table_name: str) -> DataFrame:
    """One row per column: rows, NULLs, distinct values, and total, least and
    greatest number (of a date its day number, of a string its length, of a
    boolean 1 or 0), for strings also the first and last value (IO1).

    One pass: rows are unpivoted to (column, value) and counted per value
    with a map-side combine, then per column; no column is read twice and a
    distinct count needs no expansion of its own.
    """
    day_zero = F.lit("1970-01-01").cast("date")

    def cell(f: T.StructField):
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        number = {"date": F.datediff(c, day_zero), "string": F.length(c), "boolean": c.cast("int")}.get(kind, c)
        return F.struct(F.lit(f.name).alias("column_name"), F.lit(kind == "string").alias("text"),
                        c.cast("string").alias("value"), number.cast("decimal(20,4)").alias("number"))

    cells = df.select(F.inline(F.array(*map(cell, df.schema.fields))))
    values = cells.groupBy("column_name", "text", "value", "number").agg(F.count(F.lit(1)).alias("n"))
    shown = F.when(F.col("text"), F.col("value"))
    return values.groupBy("column_name").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("distinct_count"), F.sum(F.col("number") * F.col("n").cast("decimal(20,0)")).alias("total"),
        F.min("number").alias("least"), F.max("number").alias("greatest"),
        F.min(shown).alias("first_text"), F.max(shown).alias("last_text"),
    ).select(F.lit(table_name).alias("table_name"), "*")

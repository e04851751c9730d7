"""Reading the driver's parquet tables with explicit column lists.

Every read names its columns, so the parquet scan's ReadSchema holds only what
a report needs, and filters written after the read reach the scan as
PushedFilters.
"""

from __future__ import annotations

import os
import weakref
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # type: ignore[attr-defined]


# Declared schemas of the driver tables, so no read infers one from a footer.
DECLARED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
}

# Lazy plans per live session (weak keys: a stopped session's plans go with it).
_PLANS: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def source_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """File count, bytes and modification time below ``path``, on any Hadoop
    file system; zeros where nothing is there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return 0, 0, 0
    content = store.getContentSummary(where)
    return content.getFileCount(), content.getLength(), store.getFileStatus(where).getModificationTime()


def session_plan(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Return the DataFrame built by ``build`` for ``key`` in this session.

    ``key`` ends with the path that the plan reads. A plan holds the file
    listing of the moment it was built, so it is shared only while the files
    below that path stay as they were, and built anew after a change."""
    plans = _PLANS.setdefault(spark, {})
    state = source_state(spark, key[-1])
    known = plans.get(key)
    if known is None or known[0] != state:
        known = plans[key] = (state, build())
    return known[1]


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table with its declared schema; with ``columns`` the scan is
    pruned to them. The base relation is shared within a session while the
    table's files stay the same (a lazy plan, no data is cached)."""
    path = table_path(sf_dir, name)

    def build() -> DataFrame:
        reader = spark.read.schema(DECLARED[name]) if name in DECLARED else spark.read
        return reader.parquet(path)

    df = session_plan(spark, ("table", path), build)
    return df.select(*columns) if columns else df

"""Session helpers: building a local session for tests and bench, choosing a
shared checkpoint folder, and size-checked broadcasts.

On a cluster the caller brings its own session; nothing here overrides a
setting that is already present.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the library relies on. AQE coalesces tiny shuffles and splits skewed
# join partitions at run time; ANSI mode is Spark 4's default and makes a
# division by zero an error, which is why every ratio goes through nullif.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens",
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench; the UI stays off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RECOMMENDED_CONF, **(extra_conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only set one of our own when it
    is unset, which happens in local tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/…) for this cluster")
        # Local mode only (tests, bench): a private scratch folder.
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder under the shared checkpoint folder, for files
    that are read back in this session; it is removed when the driver ends."""
    parent = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(parent)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{parent}/{kind}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared checkpoint folder.

    Reliable checkpoint (not a local one), so a lost executor does not force a
    recompute from the sources.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_count(df: DataFrame, limit: int) -> int:
    """Count at most ``limit + 1`` rows; cheap proof that a side is small."""
    return df.limit(limit + 1).count()


# File bytes up to which a lookup table read from files counts as small.
SMALL_FILE_BYTES = 4 << 20


def broadcast_lookup(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast_if_bounded`` for filters and aggregates of a lookup table:
    where the files it is read from are small, which Spark knows from their
    listing, no count is run. (Not for frames that make rows of a row.)"""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= SMALL_FILE_BYTES else broadcast_if_bounded(df, max_rows)


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when the row count is proven to be at most
    ``max_rows``; otherwise return ``df`` unchanged and let AQE choose the join
    strategy from runtime statistics."""
    if bounded_count(df, max_rows) <= max_rows:
        return F.broadcast(df)
    return df

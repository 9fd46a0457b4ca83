"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "keelson", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submit configuration wins."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KEELSON_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that arrives in fewer splits than there are cores.

    A large table already has many splits and passes through untouched; a small file with one
    row group would otherwise run its CPU-heavy text work in a single task. The size comes from the
    plan's statistics (for a scan, its files), so no job is started while the plan is built.
    """
    if df.isStreaming:
        return df
    context = df.sparkSession.sparkContext
    wanted = context.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(wanted) if size < min(wanted * SPLIT_BYTES, SPREAD_BYTES) else df


SPLIT_BYTES = 32 << 20  # an input of fewer bytes a core has too few splits
SPREAD_BYTES = 1 << 30  # no larger input is ever rebalanced


BROADCAST_ROWS = 500_000


def small_side(checked: DataFrame, joined: DataFrame | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a join side, given only after counting that it is small.

    ``checked`` is counted up to the limit; ``joined`` (default: the same frame) is what gets the
    hint and must not have more rows than ``checked``. Beyond the limit the frame comes back
    unhinted and the join shuffles, with AQE splitting hot keys.
    """
    target = checked if joined is None else joined
    return F.broadcast(target) if checked.limit(rows + 1).count() <= rows else target


def explode_rows(df: DataFrame, array, name: str, *keep: str) -> DataFrame:
    """One row per element of a costly array expression.

    A plain ``explode`` makes the optimizer infer ``size(array) > 0`` and push that filter to the
    scan, which evaluates the expression twice and, for a rebalanced input, in too few tasks. The
    outer form with a null filter behind it is evaluated once, where it stands.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def require_shared_folder(spark: SparkSession, configured: str | None) -> None:
    """A cluster must name a folder that all its machines share; local mode may do without."""
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set, in local mode (tests)."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = context.getCheckpointDir()
    if current:
        return current
    require_shared_folder(spark, configured)
    target = configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(target)
    return target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative operators call it once per round so plans stay short
    and a lost executor re-reads files instead of replaying every earlier round."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Session helpers: one place for the Spark settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()

# Settings the library assumes. Shuffle partition count is left to the cluster
# (AQE coalesces small ones); local runs pass their own.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "kohort", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a local session (one machine, as in tests) gets a
    scratch folder of its own; on a cluster that is an error, since executors would
    not see each other's files. The session's settings are never changed.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = _SCRATCH.get(sc.applicationId)
        if current is None:
            current = _SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="kohort-ckpt-", dir=os.environ.get("KOHORT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(current)
    return current


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (as --py-files does)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="kohort-pkg-"), "kohort_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(_PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def materialize(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Materialise a table an iterative job reads many times.

    ``auto``: on a cluster a reliable ``checkpoint()`` in the shared folder (it
    survives executor loss without replaying the cleaning plan, and cuts the
    lineage); in a one-machine session an in-memory/disk cache.
    """
    if mode == "auto":
        mode = "persist" if df.sparkSession.sparkContext.master.split("[")[0] == "local" else "checkpoint"
    if mode == "checkpoint":
        checkpoint_dir(df.sparkSession)      # registers the configured shared folder
        return df.checkpoint(eager=True)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df

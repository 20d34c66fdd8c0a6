"""Spark session settings the library relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library expects. The session time zone is pinned
# to UTC because a few built-ins (date_trunc, try_to_timestamp) return zoned
# TIMESTAMP values that we cast back to TIMESTAMP_NTZ; with UTC the cast keeps
# the wall-clock value.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def build_session(master: str | None = None, app: str = "loadgrid",
                  shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Create (or get) a session with the library's settings.

    On a cluster pass ``master=None`` so spark-submit decides; locally
    ``master="local[8]"`` and a small ``shuffle_partitions``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false")
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, str(v))
    spark = b.getOrCreate()
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def require_utc(spark: SparkSession | None = None) -> None:
    """Raise unless stamps keep their wall time: truncations pass through the
    session time zone, so it must be UTC (``apply_conf`` sets it)."""
    spark = spark or SparkSession.getActiveSession()
    zone = spark.conf.get("spark.sql.session.timeZone") if spark else "UTC"
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise RuntimeError(f"the session time zone is {zone!r}; call loadgrid.session.apply_conf(spark) to set UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``). Only a local session
    that has none gets a private folder, deleted at its end; on a cluster a
    missing setting is an error, as executors don't share local folders.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)        # configured in the SQL conf only
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="loadgrid-ckpt-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate, in this application's folder below
    the shared checkpoint folder; Spark deletes that folder when the driver ends."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/loadgrid/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{root}/{name}"

"""Spark session defaults and lineage helpers.

Every job in the package runs on the session returned by :func:`get_session`
(or any session the caller already owns).  Settings that change results are
pinned here: the session time zone is UTC so hour flooring of
``TIMESTAMP_NTZ`` pickups never shifts across a DST change.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for correctness or for the plan shape at scale.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # RDD checkpoints (lineage cuts) and model-training RDDs serialise with Kryo
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # The panel join and the per-zone windows are co-partitioned on the zone
    # alone (each zone has at most one row per calendar hour on both sides,
    # so this cannot skew); with the default (true) Spark reshuffles both
    # join sides on (zone, hour) and then the whole panel again on zone.
    # Hot partitions elsewhere are still split by AQE's skew-join handling.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

# Settings that can be changed on a running session (applied per query).
RUNTIME_KEYS = [k for k in DEFAULT_CONF if k.startswith("spark.sql.")]


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL defaults to an existing session (idempotent)."""
    for key in RUNTIME_KEYS:
        if spark.conf.get(key, None) != DEFAULT_CONF[key]:
            spark.conf.set(key, DEFAULT_CONF[key])
    ensure_checkpoint_dir(spark)
    return spark


def get_session(
    master: str | None = None,
    app_name: str = "slotwise",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the package defaults applied.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in settings.items():
        if not key.startswith("spark.driver") and not key.startswith("spark.executor"):
            if spark.conf.isModifiable(key):  # static settings of a running session stay as they are
                spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return the directory.

    On a cluster the shared folder comes from ``spark.checkpoint.dir``.  Only
    when that setting is absent *and* the master is local (tests, laptops) a
    fresh local folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/DBFS) before running lineage-cutting jobs"
        )
    local_dir = tempfile.mkdtemp(prefix="slotwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data is written to the shared checkpoint folder.

    Used before iterative work (cross validation, tuning) so a lost executor
    re-reads the materialised table instead of recomputing the whole plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

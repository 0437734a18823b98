"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins at run time (broadcast
# when a side turns out small, splits skewed partitions), ANSI stays on.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "matingstats",
              shuffle_partitions: int | None = None,
              checkpoint_dir: str | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library defaults.

    ``checkpoint_dir`` is used only when the cluster has not named one in
    ``spark.checkpoint.dir`` (tests pass a scratch folder here).
    """
    builder = SparkSession.builder.appName(app)
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
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to ``default`` only if unset."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    target = configured or default
    if target:
        sc.setCheckpointDir(target)
        return sc.getCheckpointDir()
    return None


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path in the checkpoint folder, which every executor can reach.

    A local session without ``spark.checkpoint.dir`` gets a folder of its own; on a cluster
    the setting is required.
    """
    base = ensure_checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="checkpoint-"))
    base = base.rstrip("/")
    return "/".join([base, *parts]) if parts else base


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, wherever that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def reliable_checkpoint(df):
    """Cut lineage of a reduced table by writing it to the shared checkpoint folder.

    Used where a table feeds several branches and before iterative loops (model fits), so that it is computed
    once and a lost executor never forces a re-read of the raw tables.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

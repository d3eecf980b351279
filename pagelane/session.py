"""Session helpers: one place for the settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings every query in the library needs, whatever session runs it.
RUNTIME_CONF = {
    # Duplicate JSON keys: the last one wins (json.loads semantics).
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pagelane") -> SparkSession:
    """The running session, or a new one; settings the deployment (or the
    caller's session) has made are kept, only unset ones are filled.

    Sizes that depend on one machine (shuffle partitions, driver memory) are
    only set for a local master.
    """
    running = SparkSession.getActiveSession()
    if running is None:
        given = SparkConf()
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        wanted = {
            "spark.ui.enabled": "false",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        }
        if is_local(master or given.get("spark.master", "")):
            wanted["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
            wanted["spark.driver.memory"] = os.environ.get("PAGELANE_DRIVER_MEMORY", "16g")
        wanted = {k: v for k, v in wanted.items() if not given.contains(k)}
        if shuffle_partitions:  # an explicit argument
            wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        running = builder.config(map=wanted).getOrCreate()
        running.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(running)
    return apply_runtime_conf(running)


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    A session on a local master that names none gets a fresh scratch folder;
    a cluster must name one on a file system that all its machines share.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="pagelane-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to a new path of the shared folder and read it
    back: later readers neither repeat its work nor depend on its executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

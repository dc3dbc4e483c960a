"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale: adaptive execution re-plans joins from real
# shuffle sizes (a small side becomes a broadcast at run time, a skewed
# partition is split), and partial aggregation is always on.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # a join side whose every shuffle partition measures under 64 MB is
    # hashed instead of sorted (a measured bound, so no memory risk)
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 << 20),
    # no broadcast from planner estimates (they are guesses through
    # aggregates); a side is broadcast only when its shuffle output measures
    # under 32 MB at run time.  Explicit hints remain for one-row tables.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 << 20),
    # a join on context and word may use sides that lie by context alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, partitions: int = 8, app: str = "textlm") -> SparkSession:
    """Session for tests and the bench; on a cluster use the cluster's own session."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("TEXTLM_DRIVER_MEMORY", "16g"))
    )
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_partial_keys(spark: SparkSession) -> None:
    """Let joins use sides that lie by some of their keys, unless the session says otherwise.

    Without it the results are the same; the side that lies by context is shuffled again.
    """
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, SCALE_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="textlm-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir

"""Session helpers.

The library never creates a session on a cluster by itself: jobs receive the
session they run in. ``get_spark`` exists for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. ANSI mode stays on (Spark 4 default); operators
# use try_* functions where the reference tolerates bad input.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method beyond 8000 bytes of bytecode: a stage of many text rules in one method is interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "propval", extra_conf: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the existing session instead."""
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("PROPVAL_MASTER", "local[*]"))
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compile_rules(spark: SparkSession) -> None:
    """Plan a given session's stages so that HotSpot compiles them, whatever number of rules they hold."""
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, DEFAULT_CONF[name])


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; only a local master may go
    without (tests, local runs), and then gets a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="propval-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Remove what this library wrote below the shared checkpoint folder (any store that Hadoop reads)."""
    base = checkpoint_dir(spark).rstrip("/")
    for name in ("propval", "propval-stream", "llm"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Parquet table access for the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from propval.operators.stats import estimated_bytes

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# dimension tables small enough that spreading them out would only add tasks
TINY_TABLES = {"region", "nation"}

# Bytes of a row group as Parquet writers make them at most, by default.
ROW_GROUP_BYTES = 128 << 20


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def balance(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over at least ``min_partitions`` tasks (default: the cluster's parallelism).

    Row-group splitting decides scan parallelism; a source stored as one big
    row group would run every per-row regex in a single task. The split count
    of a plain scan is known at planning time (no job), but a row group is read
    by one of the splits that cut it and leaves the others empty: a scan of
    fewer files than tasks counts as spread only when its bytes fill a row group
    of the usual size for each of them. Larger inputs are left untouched, so no
    shuffle is added where the data is already spread.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    if len(df.inputFiles()) < target and estimated_bytes(df) < target * ROW_GROUP_BYTES:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, balanced: bool = True) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if balanced and name not in TINY_TABLES:
        df = balance(df)
    return df

"""Materialise an intermediate table in the shared checkpoint folder.

Used where one expensive stage (regex parsing of the text columns) feeds
several statistics branches: the branches then read columnar parquet with
pruning instead of re-running the parse, and the written files cut lineage
so a lost executor does not force recomputation from the raw source.
"""

from __future__ import annotations

import os
import uuid

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from propval.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return os.path.join(checkpoint_dir(spark), "propval", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_observed(df: DataFrame, name: str, metrics: Sequence[Column]) -> tuple[DataFrame, dict]:
    """``materialize`` and aggregates over the written rows, taken by the writing job itself."""
    seen = Observation(name)
    written = materialize(df.observe(seen, *metrics), name)
    return written, seen.get

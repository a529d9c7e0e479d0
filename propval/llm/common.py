"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from propval.session import checkpoint_dir

BATCH_BYTES = 4 << 20  # of an Arrow batch sent to a Python worker, about (a longer row is a batch of its own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate table into the shared folder and read it back (cuts the lineage)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_path`` named, through Hadoop's file system (any store)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def key_text(col: Column | str) -> Column:
    """A text of any key that keeps null apart from every value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named c0, c1, ... and the new name of each: no column of a caller can clash with ours."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def slices(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold at most ``limit`` units each (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def by_bytes(batch: pa.RecordBatch, at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts (column ``at``) hold at most ``limit`` bytes, so that few are Python objects at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    for a, b in slices(sizes, limit):
        yield batch.slice(a, b - a)


def small_batches(spark: SparkSession) -> None:
    """Bound a session's Arrow batches by bytes: the JVM and the worker hold each several times, and 10,000 texts may be any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Hand what was freed back to the system: the process lives on, and Arrow and the C library would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that serves later stages too: after the last batch it gives back what the task freed."""
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return lean_run


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 by the given order, which should tell rows apart; no task sees more than a range."""
    place = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    placed = materialize(ranges, "ranked").withColumn("_range", F.shiftright("_place", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), "_range").withColumn("rank", rank).drop("_place", "_range", "_before")

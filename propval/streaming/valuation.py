"""Structured Streaming jobs.

Q1 stream_valuation: asks arriving as files -> stream-static joins with the
fitted artefacts -> the same ``decide`` columns as batch -> append sink.
Q2 event_window_stats: event stream with a watermark and tumbling windows; every
window that a micro-batch changed is written again, and the report shows each
window's latest state, so no event waits for a watermark to pass. Events behind the watermark do not count there.
Q2 feedback_stats: the feedback log as a stream, summed per window in the same way.
Q2 split_late: a stream's events without repeats, and those behind the watermark as a table of their own.

The caller names ``state_path``, a folder in shared storage that belongs to the
job. Checkpoint and sink live below it: a job started again with the same path
goes on where it stopped. All use an ``availableNow`` trigger for bounded runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propval.operators import decide as D
from propval.operators.stats import attach_scalars
from propval.plans.materialize import materialize


def _append(stream_df: DataFrame, state_path: str) -> DataFrame:
    """Run what is available; all rows the job has ever appended."""
    out = f"{state_path.rstrip('/')}/out"
    q = (stream_df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{state_path.rstrip('/')}/checkpoint")
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(out)


def _latest(stream_df: DataFrame, keys: list[str], state_path: str) -> DataFrame:
    """Run what is available in update mode; the latest row of every key.

    A micro-batch writes its changed rows below its own number; a batch that is run again after a failure
    overwrites its first attempt.
    """
    out = f"{state_path.rstrip('/')}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = (stream_df.writeStream.foreachBatch(write).outputMode("update")
         .option("checkpointLocation", f"{state_path.rstrip('/')}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType([*stream_df.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in stream_df.columns if c not in keys]
    rows = stream_df.sparkSession.read.schema(schema).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in stream_df.columns])


def stream_valuation(spark: SparkSession, asks_path: str, schema: T.StructType, rarity: DataFrame,
                     pps: DataFrame, pps_gm: DataFrame, state_path: str) -> DataFrame:
    """Q1: decisions for every ask that has landed in ``asks_path`` since the job first ran."""
    asks = spark.readStream.schema(schema).parquet(asks_path)
    return _append(D.decide(asks, rarity, pps, pps_gm), state_path)


def event_window_stats(spark: SparkSession, events_path: str, schema: T.StructType, state_path: str,
                       window: str = "6 hours", watermark: str = "1 hour") -> DataFrame:
    """Q2 (streaming form): events per type and tumbling window, with a watermark for late data."""
    ev = spark.readStream.schema(schema).parquet(events_path)
    ev = ev.withColumn("event_time", F.col("ts").cast("timestamp"))  # watermarks need TIMESTAMP, not NTZ
    agg = (ev.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", window).alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value")))
    flat = agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", "avg_value")
    return _latest(flat, ["window_start", "window_end", "event_type"], state_path)


def feedback_stats(spark: SparkSession, log_path: str, schema: T.StructType, state_path: str,
                   window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Q2: feedback per window, type, alert and confidence, from the log read as a stream."""
    fb = spark.readStream.schema(schema).parquet(log_path)
    # errors in whole millionths: their sum does not depend on the order of rows and batches
    micro = F.round(F.abs(F.col("price") - F.col("predicted")) / F.col("price") * 1e6).cast("long")
    agg = (fb.withWatermark("timestamp", watermark)
           .groupBy(F.window("timestamp", window).alias("w"), "type", "alert", "confidence")
           .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("feedback") == "up").cast("double")).alias("up_share"),
                (F.sum(micro) / F.count(F.lit(1)) / 1e6).alias("mean_ape")))
    flat = agg.select(F.col("w.start").alias("window_start"), "type", "alert", "confidence", "n", "up_share", "mean_ape")
    return _latest(flat, ["window_start", "type", "alert", "confidence"], state_path)


@dataclass
class Split:
    """What a stream has brought so far: every event, by its key, is in exactly one of the two tables."""

    accepted: DataFrame  # events that came in time, their first arrival
    late: DataFrame      # events that came behind the watermark, with the watermark that they missed


def split_late(spark: SparkSession, landing: str, schema: T.StructType, keys: list[str], time: str, state_path: str,
               delay: str = "1 hour") -> Split:
    """Q2: repeated events removed and late ones put aside instead of dropped untold.

    A micro-batch's watermark is the latest event time of the batches before it less ``delay``. An event behind it goes
    to ``late``, any other to ``accepted``; one that has arrived before, in either table, is a repeat. A repeat has its
    event's time, so only the days that a batch holds events of are searched. Batches write below their own
    number: one that is run again after a failure finds the same earlier batches and overwrites its first attempt.
    """
    base = state_path.rstrip("/")
    stored = T.StructType([*schema.fields, T.StructField("watermark", T.TimestampType())])
    placed = T.StructType([*stored.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
    marks = T.StructType([T.StructField("latest", T.TimestampType()), T.StructField("batch", T.LongType())])

    def earlier(name: str, kind: T.StructType, number: int) -> DataFrame:
        # the folder of a table exists from its first batch on
        return spark.read.schema(kind).option("basePath", f"{base}/{name}").parquet(f"{base}/{name}/batch=*") \
            .where(F.col("batch") < number) if number else spark.createDataFrame([], kind)

    def write(batch: DataFrame, number: int) -> None:
        at = F.col(time).cast("timestamp")
        mark = earlier("marks", marks, number).agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("watermark"))
        rows = materialize(attach_scalars(batch.dropDuplicates(keys), mark).withColumn("day", at.cast("date")), "stream_batch")
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # the days of one micro-batch
        for name in ("accepted", "late"):
            old = earlier(name, placed, number).where(F.col("day").isin(days) | F.col("day").isNull()).select(*keys)
            rows = rows.join(old, keys, "left_anti")
        fresh = materialize(rows, "stream_fresh")
        behind = F.coalesce(at < F.col("watermark"), F.lit(False))
        for name, part in (("accepted", fresh.where(~behind)), ("late", fresh.where(behind))):
            part.write.mode("overwrite").partitionBy("day").parquet(f"{base}/{name}/batch={number}")
        batch.agg(F.max(at).alias("latest")).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")

    q = (spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    read = {n: spark.read.schema(placed).parquet(f"{base}/{n}") for n in ("accepted", "late")}
    return Split(read["accepted"].select(*schema.names, "batch"), read["late"].select(*schema.names, "watermark", "batch"))

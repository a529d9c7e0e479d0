"""The feedback log (timestamp, price, predicted, type, alert, confidence, feedback)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("listing_id", T.LongType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("predicted", T.DoubleType(), True),
    T.StructField("alert", T.StringType(), True),
    T.StructField("confidence", T.StringType(), True),
    T.StructField("feedback", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
])


def write_feedback(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append feedback rows, partitioned by property type (partition pruning for per-type reports)."""
    df.select(*[f.name for f in FEEDBACK_SCHEMA.fields]).write.mode(mode).partitionBy("type").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA).parquet(path)


def read_feedback_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV form of the log (header: timestamp, price, predicted, type, alert, confidence, feedback)."""
    schema = T.StructType([
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("price", T.DoubleType(), True),
        T.StructField("predicted", T.DoubleType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("alert", T.StringType(), True),
        T.StructField("confidence", T.StringType(), True),
        T.StructField("feedback", T.StringType(), True),
    ])
    return spark.read.schema(schema).option("header", "true").csv(path)

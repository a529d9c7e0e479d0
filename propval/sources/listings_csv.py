"""Raw listings as CSV with an explicit all-text schema (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RAW_TEXT_COLUMNS = ["url", "price", "size", "bedrooms", "bathrooms", "payment_method",
                    "down_payment", "type", "location", "description"]

RAW_SCHEMA = T.StructType(
    [T.StructField("listing_id", T.LongType(), True)]
    + [T.StructField(c, T.StringType(), True) for c in RAW_TEXT_COLUMNS]
    + [T.StructField("listed_at", T.StringType(), True)]
)

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "encoding": "UTF-8",
               "mode": "PERMISSIVE"}


# A file read with line breaks in its fields is one task, whatever its size.
ROWS_PER_FILE = 100_000


def read_listings_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Read listing CSV files; every column is text so prices keep their raw form.

    By default a record is one line, and Spark splits large files. ``multi_line`` reads files whose quoted fields
    hold line breaks; each file is then one task, so such a feed should come as many files of moderate size.
    """
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    for k, v in CSV_OPTIONS.items():
        reader = reader.option(k, v)
    df = reader.csv(path)
    # the down payment column is optional in the source files
    if "down_payment" not in df.columns:
        from pyspark.sql import functions as F
        df = df.withColumn("down_payment", F.lit(None).cast("string"))
    return df


def write_listings_csv(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write listings as header CSV (quoted, UTF-8); a partition gets a file for every ``rows_per_file`` rows."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    for k, v in CSV_OPTIONS.items():
        if k in ("header", "escape", "quote", "encoding"):
            writer = writer.option(k, v)
    # the writer would strip blanks at the ends of values
    writer.options(quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)

from pyspark.sql import functions as F

from propval.sources.listings_csv import RAW_TEXT_COLUMNS, read_listings_csv, write_listings_csv


def test_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    rows = spark.range(0, 50, numPartitions=1).select(
        F.col("id").alias("listing_id"), *[F.concat(F.lit(f"{c}\n \"x\", "), "id").alias(c) for c in RAW_TEXT_COLUMNS])
    path = str(tmp_path / "listings")
    write_listings_csv(rows, path, rows_per_file=20)
    back = read_listings_csv(spark, path, multi_line=True).drop("listed_at")
    per_file = back.groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in per_file) == [10, 20, 20]
    assert sorted(back.select(rows.columns).collect()) == sorted(rows.collect())

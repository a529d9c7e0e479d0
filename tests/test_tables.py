"""Scans are spread over the tasks by their rows."""

from propval.sources.tables import balance


def test_a_row_group_cut_by_many_splits_is_spread(spark, tmp_path):
    spark.range(0, 20_000, numPartitions=1).selectExpr("id", "sha2(cast(id as string), 256) AS x").write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        df = spark.read.parquet(f"{tmp_path}/t")
        assert df.rdd.getNumPartitions() >= 4  # one file of one row group, many splits
        sizes = [n for n in balance(df, 4).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(sizes) == 4 and sum(sizes) == 20_000 and max(sizes) < 6_000

"""Streams resume from the caller's folder, and no event waits for the watermark."""

from pyspark.sql import functions as F

from propval.plans import catalog
from propval.streaming import valuation as V
from tests.conftest import SF_SMALL


def test_a_restarted_valuation_decides_every_ask_once(spark, tmp_path):
    asks, enc = catalog._decision_input(spark, SF_SMALL), catalog._encodings(spark, SF_SMALL)
    counts = []
    for half in (0, 1):
        asks.where(F.pmod("listing_id", F.lit(2)) == half).write.mode("append").parquet(str(tmp_path / "asks"))
        out = V.stream_valuation(spark, str(tmp_path / "asks"), asks.schema, enc.rarity, enc.pps_map, enc.pps_gm, str(tmp_path / "job"))
        counts.append((out.count(), out.select("listing_id").distinct().count()))
    n = asks.count()
    assert counts[0][0] < n and counts[1] == (n, n)


def test_all_events_are_counted_over_two_runs(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for half in (0, 1):
        events.where(F.pmod(F.xxhash64("ts"), F.lit(2)) == half).write.mode("append").parquet(str(tmp_path / "ev"))
        out = V.event_window_stats(spark, str(tmp_path / "ev"), events.schema, str(tmp_path / "job"), watermark="3650 days")
    assert out.agg(F.sum("n")).first()[0] == events.count()
    assert out.count() == out.select("window_start", "event_type").distinct().count()


def test_every_event_is_accepted_or_late_once(spark, tmp_path):
    lots = [
        [(1, "2024-01-01 10:00:00", 1), (2, "2024-01-01 11:00:00", 1), (1, "2024-01-01 10:00:00", 1)],
        [(3, "2024-01-01 15:00:00", 1), (2, "2024-01-01 11:00:00", 1), (4, "2024-01-01 09:00:00", 1)],
        [(5, "2024-01-01 12:00:00", 1), (6, "2024-01-01 14:30:00", 1), (4, "2024-01-01 09:00:00", 1), (3, "2024-01-01 15:00:00", 1), (7, None, 1)],
        [(5, "2024-01-01 12:00:00", 1), (6, "2024-01-01 14:30:00", 1), (8, "2024-01-02 00:00:00", 1)],
    ]
    for lot in lots:
        df = spark.createDataFrame(lot, "id long, ts string, v int").select("id", F.col("ts").cast("timestamp").alias("ts"), "v")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        split = V.split_late(spark, str(tmp_path / "in"), df.schema, ["id"], "ts", str(tmp_path / "job"))
    accepted, late = ({r["id"]: r["batch"] for r in t.collect()} for t in (split.accepted, split.late))
    assert accepted == {1: 0, 2: 0, 3: 1, 6: 2, 7: 2, 8: 3} and late == {4: 1, 5: 2}
    assert split.accepted.count() == 6 and split.late.count() == 2

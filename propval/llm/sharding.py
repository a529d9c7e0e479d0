"""Operator 9: weighted rendezvous hashing of stable record keys.

Every record draws one uniform number u per shard from md5(key, shard); the shard with the smallest
-ln(u) / weight owns it. A shard that joins or leaves touches only the draws it takes part in, so the
records that move are the new shard's share and no others move. All columns are native expressions.

Defined results: a null key is a key of its own; empty and null texts have size 1 and checksum 0 or null
respectively; equal draws (never seen with 52 bits) go to the smaller shard number; repeated rows share a
shard and take consecutive slots; an empty table gives no rows; other columns are ignored by ``slots``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from propval.llm.common import key_text, materialize, table

DRAW_HEX = 13  # hex digits of a draw: 52 bits, exact in a double
BUCKET_HEX = 3  # hex digits of the sub-bucket that numbers slots in parallel


def _cost(key: Column, shard: int, weight: float) -> Column:
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, DRAW_HEX), 16, 10).cast("double")
    return -F.log((draw + 0.5) / float(1 << 4 * DRAW_HEX)) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The owning shard (0 .. n-1) of a key text; shards of weight 0 own nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    costs = [F.struct(_cost(key, s, float(w)).alias("cost"), F.lit(s).alias("shard"))
             for s, w in enumerate(weights) if w > 0]
    return costs[0]["shard"] if len(costs) == 1 else F.least(*costs)["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard",
           grown: Sequence[float] | None = None, grown_out: str = "grown_shard") -> DataFrame:
    """``df`` with its shard, and the shard under ``grown`` weights when given."""
    df = df.withColumn(out, rendezvous(key_text(df[key]), weights))
    return df if grown is None else df.withColumn(grown_out, rendezvous(key_text(F.col(key)), grown))


def slots(rows: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """One row per input row with the columns ``shard`` and ``order`` and its gapless ``slot`` in the shard.

    Equal rows are counted before the shuffle, so a key that holds a third of all rows is one row here.
    Each shard is numbered in 16^BUCKET_HEX sub-buckets at once; only their sums are put in sequence.
    """
    tag = F.concat_ws(":", *[key_text(c) for c in order])
    classes = materialize(
        rows.groupBy(shard, *order).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.substring(F.md5(tag), 1, BUCKET_HEX)), "shard-classes")
    sums = classes.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(shard, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    numbered = classes.join(offsets, [shard, "_bucket"]).select(shard, *order, "_n", first.alias("_first"))
    return numbered.select(shard, *order, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"))


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards by doc_id, their slot, and the shard of a 17-shard layout."""
    docs = table(spark, sf_dir, "documents")
    rows = assign(docs, "doc_id", [1.0] * 16, grown=[1.0] * 17).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), "shard", "grown_shard")
    out = slots(rows, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

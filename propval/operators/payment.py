"""Payment terms -> cash-equivalent price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.functions import rules as R
from propval.functions.regex import py_strip


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def installment_tier_col(years: Column) -> Column:
    """Cash (<= 0 or missing), short, medium, long, very_long."""
    expr = F.when(years.isNull() | F.isnan(years) | (years <= 0), F.lit("cash"))
    for bound, tier in R.INSTALLMENT_TIERS:
        expr = expr.when(years <= bound, F.lit(tier))
    return expr.otherwise(F.lit(R.INSTALLMENT_TOP))


def down_payment_tier_col(ratio: Column) -> Column:
    """High (>= .30), medium (>= .15, or missing / <= 0), low (>= .05), very_low."""
    expr = F.when(ratio.isNull() | F.isnan(ratio) | (ratio <= 0), F.lit("medium"))
    for bound, tier in R.DOWN_PAYMENT_TIERS:
        expr = expr.when(ratio >= bound, F.lit(tier))
    return expr.otherwise(F.lit(R.DOWN_PAYMENT_BOTTOM))


def adjust_price(df: DataFrame, price: str = "ask", payment_type: str = "payment_type",
                 years: str = "installment_years", dp_ratio: str = "down_payment_ratio") -> DataFrame:
    """Cash-equivalent price plus the metadata struct and an Arabic explanation.

    Long plans are discounted at 14 %/year (present value); short/medium plans
    divide by a capped linear multiplier; non-installment payments are unchanged.
    """
    p = F.col(price)
    ptype = F.lower(py_strip(F.coalesce(F.col(payment_type).cast("string"), F.lit("None"))))
    is_inst = F.lit(False)
    for kw in R.PAYMENT_INSTALLMENT_WORDS:
        is_inst = is_inst | ptype.contains(kw)
    y = F.col(years).cast("double")
    df = df.select("*", is_inst.alias("_is_inst"), installment_tier_col(y).alias("_itier"),
                   down_payment_tier_col(F.col(dp_ratio).cast("double")).alias("_dtier"))
    itier, dtier = F.col("_itier"), F.col("_dtier")
    dp_add = F.coalesce(_map(R.DOWN_PAYMENT_IMPACT)[dtier], F.lit(0.03))
    pv = F.least(F.lit(1.0) / F.pow(F.lit(1.0 + R.ANNUAL_DISCOUNT_RATE), y) + dp_add, F.lit(1.0))
    lin = F.least(F.coalesce(_map(R.INSTALLMENT_MULTIPLIERS)[itier], F.lit(1.10)) + dp_add, F.lit(R.LINEAR_MULT_CAP))
    long_plan = itier.isin("long", "very_long") & (y > 0)
    adjusted = (F.when(~F.col("_is_inst"), p).when(itier == "cash", p).when(long_plan, p * pv).otherwise(p / lin))
    rate = F.when(F.col("_is_inst") & long_plan, F.lit(R.ANNUAL_DISCOUNT_RATE)).otherwise(F.lit(0.0))
    df = df.select("*", adjusted.alias("adjusted_price"), rate.alias("discount_rate"))
    a = F.col("adjusted_price")
    mult = F.when(~F.col("_is_inst"), F.lit(1.0)).when(a > 0, p / a).otherwise(F.lit(1.0))
    df = df.select(
        "*", mult.alias("multiplier"),
        F.when(F.col("_is_inst"), itier).otherwise(F.lit("cash")).alias("installment_tier"),
        F.when(F.col("_is_inst"), dtier).otherwise(F.lit("high")).alias("down_payment_tier"),
        F.when(~F.col("_is_inst"), F.lit("cash")).when(F.col("discount_rate") > 0, F.lit("pv"))
        .otherwise(F.lit("linear")).alias("method"),
    )
    df = df.withColumn("is_adjusted", F.col("_is_inst") & (F.col("multiplier") > R.ADJUSTED_THRESHOLD))
    t = F.col("installment_tier")
    explanation = (F.when(~F.col("is_adjusted"), F.lit(""))
                   .when(F.col("method") == "pv", F.lit(R.PAY_AR_PV))
                   .when(t == "short", F.lit(R.PAY_AR_SHORT))
                   .when(t.isin("long", "very_long"), F.lit(R.PAY_AR_LONG))
                   .otherwise(F.lit(R.PAY_AR_OTHER)))
    meta = F.struct(
        p.alias("original_price"), a.alias("adjusted_price"), F.col("multiplier"), t.alias("installment_tier"),
        F.col("down_payment_tier"), F.col(payment_type).alias("payment_type"),
        F.when(F.col("_is_inst"), y).otherwise(F.lit(0.0)).alias("installment_years"),
        F.col(dp_ratio).alias("down_payment_ratio"), F.col("is_adjusted"), F.col("discount_rate"), F.col("method"))
    return df.select("*", explanation.alias("payment_explanation"), meta.alias("payment_meta")) \
             .drop("_is_inst", "_itier", "_dtier")


def tier_summary(adjusted: DataFrame) -> DataFrame:
    """J8 aggregate: listings, mean multiplier and totals by installment x down-payment tier."""
    return adjusted.groupBy("installment_tier", "down_payment_tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("multiplier").alias("avg_multiplier"),
        F.round(F.sum("adjusted_price"), 2).alias("sum_adjusted"))  # currency total in cents

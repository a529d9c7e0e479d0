"""Rental operators (R1-R7) as column expressions.

Inputs: ``sale_price`` (estimated sale value), ``user_rent`` (asked monthly
rent), ``type_clean``, ``area``, ``compound``, ``desc`` and the rental feature
columns from :func:`propval.operators.text.add_rental_features`. The rarity
artefact (city, type_clean, rarity) is joined on the raw (area, type) key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.functions import fmt
from propval.functions import rules as R
from propval.functions.regex import py_strip
from propval.operators.stats import broadcast_if_small
from propval.operators.text import source_columns


def rent_zone_col(area: Column, compound: Column, desc: Column) -> Column:
    """First zone whose literal words occur in 'area compound desc' (lower-cased).

    With ``compound`` and ``desc`` set to None, ``area`` is taken as the prepared lower-case blob.
    """
    if compound is None and desc is None:
        blob = area
    else:
        blob = F.lower(F.concat_ws(" ", F.coalesce(area, F.lit("")), F.coalesce(compound, F.lit("")),
                                   F.coalesce(desc, F.lit(""))))
    expr = None
    for zone, words in R.RENT_ZONE_WORDS:
        cond = F.lit(False)
        for w in words:
            cond = cond | blob.contains(w)
        expr = F.when(cond, F.lit(zone)) if expr is None else expr.when(cond, F.lit(zone))
    return expr.otherwise(F.lit(R.RENT_ZONE_DEFAULT))


def _yield_lookup(zone: Column, type_: Column):
    key = F.concat_ws("|", zone, type_)
    fallback = F.concat_ws("|", zone, F.lit("Apartment"))

    def m(i):
        return F.create_map(*[x for (z, t), y in R.RENTAL_YIELDS.items() for x in (F.lit(f"{z}|{t}"), F.lit(y[i]))])

    exact = m(0)[key].isNotNull()
    fb = m(0)[fallback].isNotNull()
    vals = [F.when(exact, m(i)[key]).when(fb, m(i)[fallback]).otherwise(F.lit(R.DEFAULT_YIELD[i])) for i in range(3)]
    conf = F.when(exact, "HIGH").when(fb, "MEDIUM").otherwise("LOW")
    return vals, conf


def add_rent_estimate(df: DataFrame, sale_price: str = "sale_price") -> DataFrame:
    """R2: yield lookup (exact, then (zone, Apartment), then default) and MAPE-guarded rent range."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(F.col("area"), F.lit("")), F.coalesce(F.col("compound"), F.lit("")),
                               F.coalesce(F.col("desc"), F.lit(""))))
    df = df.withColumn("_rz_blob", blob)
    df = df.withColumn("rent_zone", rent_zone_col(F.col("_rz_blob"), None, None)).drop("_rz_blob")
    (y_min, y_max, y_typ), conf = _yield_lookup(F.col("rent_zone"), F.col("type_clean"))
    mape = F.coalesce(F.create_map(*[x for k, v in R.MAPE_BY_TYPE.items() for x in (F.lit(k), F.lit(v))])
                      [F.col("type_clean")], F.lit(R.DEFAULT_MAPE))
    p = F.col(sale_price)
    df = df.select("*", y_min.alias("yield_min"), y_max.alias("yield_max"), y_typ.alias("yield_typical"),
                   conf.alias("estimate_confidence"), mape.alias("sale_mape"))
    buf = F.lit(1.0) + F.col("sale_mape")
    return df.select("*",
                     (p * F.col("yield_min") / R.MONTHS / buf).alias("min_rent"),
                     (p * F.col("yield_typical") / R.MONTHS).alias("mid_rent"),
                     (p * F.col("yield_max") / R.MONTHS * buf).alias("max_rent"))


def add_premium(df: DataFrame, score: str = "feature_score") -> DataFrame:
    """Premium share and tier from the weighted feature score."""
    s = F.col(score)
    prem = tier = None
    for bound, p, t in R.PREMIUM_TIERS:
        prem = F.when(s <= bound, F.lit(p)) if prem is None else prem.when(s <= bound, F.lit(p))
        tier = F.when(s <= bound, F.lit(t)) if tier is None else tier.when(s <= bound, F.lit(t))
    prem = F.least(prem.otherwise(F.lit(R.PREMIUM_TOP[0])), F.lit(R.PREMIUM_CAP))
    return df.select("*", prem.alias("premium_pct"), tier.otherwise(F.lit(R.PREMIUM_TOP[1])).alias("feature_tier"))


def add_rental_confidence(df: DataFrame, rarity: DataFrame | None = None) -> DataFrame:
    """50 + sources (cap 80) + area + description length - rarity, clamped 20..95."""
    src = sum((F.when(F.col(c) == "checkbox", R.RENT_CONF_CHECKBOX).when(F.col(c) == "nlp", R.RENT_CONF_NLP)
               .otherwise(0) for c in source_columns()), F.lit(R.RENT_CONF_BASE))
    score = F.least(src, F.lit(R.RENT_CONF_SOURCE_CAP))
    df = df.withColumn("_rc_area", F.lower(F.coalesce(F.col("area").cast("string"), F.lit("nan"))))
    a = F.col("_rc_area")
    good = F.lit(False)
    for w in R.RENT_GOOD_AREAS:
        good = good | a.contains(w)
    score = score + (F.when(a.isin(*R.RENT_UNKNOWN_AREAS), R.RENT_AREA_UNKNOWN)
                     .when(good, R.RENT_AREA_GOOD).otherwise(R.RENT_AREA_OTHER))
    n = F.char_length(py_strip(F.coalesce(F.col("desc"), F.lit(""))))
    score = score + F.when(n < R.RENT_DESC_SHORT, R.RENT_DESC_SHORT_ADJ).when(n > R.RENT_DESC_LONG,
                                                                              R.RENT_DESC_LONG_ADJ).otherwise(0)
    if rarity is not None:
        r = rarity.select(F.col("city").alias("_r_area"), F.col("type_clean").alias("_r_type"),
                          F.col("rarity").alias("_rarity"))
        df = df.join(broadcast_if_small(r), (F.col("area") == F.col("_r_area"))
                     & (F.col("type_clean") == F.col("_r_type")), "left")
        rr = F.coalesce(F.col("_rarity"), F.lit(0.0))
        score = score + F.when(rr > R.RENT_RARITY_HIGH, R.RENT_RARITY_HIGH_ADJ).when(
            rr > R.RENT_RARITY_MED, R.RENT_RARITY_MED_ADJ).otherwise(0)
    df = df.withColumn("rent_conf_score", F.least(F.greatest(score, F.lit(R.SCORE_RANGE[0])),
                                                  F.lit(R.SCORE_RANGE[1])))
    s = F.col("rent_conf_score")
    df = df.withColumn("rent_conf_level", F.when(s >= R.LEVEL_HIGH, "HIGH").when(s >= R.LEVEL_MEDIUM, "MEDIUM")
                       .otherwise("LOW"))
    return df.drop(*[c for c in ("_r_area", "_r_type", "_rarity", "_rc_area") if c in df.columns])


def add_rental_decision(df: DataFrame, user_rent: str = "user_rent", expected: str = "adj_mid",
                        confidence: str = "rental_confidence") -> DataFrame:
    """Band by confidence; ratio < 0.5 or > 2 forces the alert and LOW."""
    e = F.col(expected)
    df = df.withColumn("rent_ratio", F.when(e > 0, F.col(user_rent) / e).otherwise(F.lit(1.0)))
    c = F.col(confidence)
    lower = F.when(c == "LOW", R.RENT_BANDS["LOW"][0]).when(c == "HIGH", R.RENT_BANDS["HIGH"][0]) \
             .otherwise(R.RENT_BANDS["MEDIUM"][0])
    upper = F.when(c == "LOW", R.RENT_BANDS["LOW"][1]).when(c == "HIGH", R.RENT_BANDS["HIGH"][1]) \
             .otherwise(R.RENT_BANDS["MEDIUM"][1])
    df = df.select("*", lower.alias("threshold_lower"), upper.alias("threshold_upper"))
    r = F.col("rent_ratio")
    alert = (F.when(r < R.RENT_EXTREME_LOW, "UNDERPRICED").when(r > R.RENT_EXTREME_HIGH, "OVERPRICED")
             .when(r < F.col("threshold_lower"), "UNDERPRICED").when(r > F.col("threshold_upper"), "OVERPRICED")
             .otherwise("FAIR"))
    dec_conf = F.when((r < R.RENT_EXTREME_LOW) | (r > R.RENT_EXTREME_HIGH), F.lit("LOW")).otherwise(c)
    return df.select("*", alert.alias("rent_alert"), dec_conf.alias("decision_confidence"))


def rental_reason_col(alert: Column, lo: Column, hi: Column, confidence: Column, score: Column,
                      zone: Column) -> Column:
    """Two Arabic lines: position vs the expected range, then what the estimate rests on."""
    label = F.coalesce(F.create_map(*[x for k, v in R.RENT_ZONE_LABELS.items() for x in (F.lit(k), F.lit(v))])[zone],
                       F.lit(R.RENT_ZONE_LABELS["urban"]))
    low, high = fmt.price_egp(lo), fmt.price_egp(hi)

    def fill(t):
        a, rest = t.split("{lo}")
        b, rest = rest.split("{hi}")
        c, d = rest.split("{zone}")
        return F.concat(F.lit(a), low, F.lit(b), high, F.lit(c), label, F.lit(d))

    line1 = F.when(alert == "UNDERPRICED", fill(R.RENT_AR_UNDER)).when(alert == "OVERPRICED", fill(R.RENT_AR_OVER)) \
             .otherwise(fill(R.RENT_AR_FAIR))
    line2 = (F.when(confidence == "LOW", F.lit(R.RENT_AR_LOW)).when(score >= R.RENT_SCORE_MANY, F.lit(R.RENT_AR_MANY))
             .when(score >= R.RENT_SCORE_SOME, F.lit(R.RENT_AR_SOME)).otherwise(F.lit(R.RENT_AR_BASIC)))
    return F.concat(line1, F.lit("\n"), line2)


def analyze_rental(df: DataFrame, rarity: DataFrame | None = None) -> DataFrame:
    """Estimate, premium, confidence merge, decision and reason; flat columns plus a nested struct."""
    df = add_premium(df)
    df = add_rent_estimate(df)
    one = F.lit(1.0) + F.col("premium_pct")
    df = df.select("*", (F.col("min_rent") * one).alias("adj_min"), (F.col("mid_rent") * one).alias("adj_mid"),
                   (F.col("max_rent") * one).alias("adj_max"))
    df = add_rental_confidence(df, rarity)
    est, lvl = F.col("estimate_confidence"), F.col("rent_conf_level")
    final = F.when((est == "LOW") | (lvl == "LOW"), "LOW").when((est == "MEDIUM") | (lvl == "MEDIUM"), "MEDIUM") \
             .otherwise("HIGH")
    df = df.withColumn("rental_confidence", final)
    df = add_rental_decision(df)
    df = df.withColumn("rental_reason", rental_reason_col(F.col("rent_alert"), F.col("adj_min"), F.col("adj_max"),
                                                          F.col("rental_confidence"), F.col("feature_score"),
                                                          F.col("rent_zone")))
    result = F.struct(
        F.lit("rental").alias("mode"), F.col("rent_alert").alias("alert"), F.col("rental_reason").alias("reason"),
        F.col("rental_confidence").alias("confidence"), F.col("rent_conf_score").alias("confidence_score"),
        F.col("rent_ratio").alias("ratio"), F.col("user_rent").alias("user_rent"),
        F.struct(F.col("adj_min").alias("min"), F.col("adj_mid").alias("mid"), F.col("adj_max").alias("max"))
        .alias("expected_rent_range"),
        F.col("sale_price").alias("sale_price_estimate"),
        F.struct(F.col("yield_min").alias("min"), F.col("yield_typical").alias("typical"),
                 F.col("yield_max").alias("max")).alias("yield"),
        F.col("rent_zone").alias("zone"), F.col("premium_pct"), F.col("feature_score"), F.col("feature_tier"),
        F.col("active_features"),
        F.struct(F.col("threshold_lower").alias("lower"), F.col("threshold_upper").alias("upper")).alias("thresholds"),
    )
    return df.withColumn("rental", result)

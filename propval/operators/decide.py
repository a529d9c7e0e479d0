"""Decision operators (D1-D18): asks + prediction intervals -> alert, confidence, reason.

Input columns (rename upstream if yours differ):
  ask, pred, lo, hi          asking price and predicted price interval (EGP)
  type_clean, area           property type, area/city text
  in_compound                'yes' / 'no'
  developer_level, has_pool  'premium'/'unknown', 'yes'/'no'
  land_size                  'present' / 'missing'
  desc, compound             free text used for the villa market zone
  size_sqm                   area for the benchmark check
Artefacts (small DataFrames, one row per city x type): ``rarity`` (city,
type_clean, rarity) and ``pps`` (city, type_clean, lpps) plus a one-row
``pps_gm`` (pps_gm). Every step is a column expression; the artefact lookups
are left joins on the trimmed (area, type) key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.functions import fmt
from propval.functions import rules as R
from propval.functions.regex import contains_any, has, py_strip
from propval.operators.stats import attach_scalars, broadcast_if_small

ALERTS = ("UNDERPRICED", "FAIR", "OVERPRICED")


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _trunc_int(c: Column) -> Column:
    """Python int(): truncation toward zero."""
    return c.cast("int")


def _clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


# ---------------------------------------------------------------------------
# D1-D3 price corrections
# ---------------------------------------------------------------------------

def add_bias_correction(df: DataFrame, cols=("pred", "lo", "hi"), suffix: str = "_b") -> DataFrame:
    """Divide by 1.041 inside a compound, 1.051 otherwise."""
    factor = F.when(F.col("in_compound") == "yes", F.lit(R.BIAS_FACTOR["compound"])) \
              .otherwise(F.lit(R.BIAS_FACTOR["standalone"]))
    return df.select("*", *[(F.col(c) / factor).alias(c + suffix) for c in cols])


def standalone_discount_col(area: Column, in_compound: Column) -> Column:
    """1.0 unless standalone in a premium city; then the first matching city factor."""
    a = F.lower(F.coalesce(area.cast("string"), F.lit("nan")))
    premium = contains_any(a, R.PREMIUM_CITIES)
    chain = None
    for city, d in R.STANDALONE_CALIBRATION:
        cond = a.contains(city)
        chain = F.when(cond, F.lit(d)) if chain is None else chain.when(cond, F.lit(d))
    by_city = chain.otherwise(F.lit(R.DEFAULT_STANDALONE_DISCOUNT))
    return F.when(in_compound == "yes", F.lit(1.0)).when(~premium, F.lit(1.0)).otherwise(by_city)


def add_standalone_calibration(df: DataFrame, src_suffix: str = "_b", suffix: str = "_c",
                               cols=("pred", "lo", "hi")) -> DataFrame:
    """X -> expm1(log1p(x) + ln(d)) when the discount d < 0.99."""
    df = df.withColumn("discount", standalone_discount_col(F.col("area"), F.col("in_compound")))
    d = F.col("discount")
    out = [F.when(d >= 0.99, F.col(c + src_suffix))
           .otherwise(F.expm1(F.log1p(F.col(c + src_suffix)) + F.log(d))).alias(c + suffix) for c in cols]
    return df.select("*", *out)


def villa_zone_col(area: Column, desc: Column, compound: Column) -> Column:
    """D3: zone from 'area desc compound' (lower-cased)."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(area.cast("string"), F.lit("nan")),
                               F.coalesce(desc, F.lit("")), F.coalesce(compound, F.lit(""))))
    return (F.when(has(blob, R.COASTAL_PATTERNS), F.lit("coastal"))
            .when(has(blob, R.RED_SEA_PATTERNS), F.lit("red_sea"))
            .otherwise(F.lit("urban")))


def villa_factor_col(zone: Column) -> Column:
    factors = {z: m / R.VILLA_CLUSTER_OVERALL_MEDIAN for z, m in R.VILLA_CLUSTER_MEDIAN_P50.items()}
    return F.coalesce(_map(factors)[zone], F.lit(1.0))


def add_villa_correction(df: DataFrame) -> DataFrame:
    """D3: villas get the zone factor; other types keep the calibrated price."""
    is_villa = F.col("type_clean") == "Villa"
    df = df.withColumn("zone", F.when(is_villa, villa_zone_col(F.col("area"), F.col("desc"), F.col("compound")))
                       .otherwise(F.lit("")))
    f = F.when(is_villa, villa_factor_col(F.col("zone"))).otherwise(F.lit(1.0))
    return df.select("*", *[(F.col(c + "_c") * f).alias(c + "_f") for c in ("pred", "lo", "hi")])


# ---------------------------------------------------------------------------
# D4 band, D5 alert, D6 confidence
# ---------------------------------------------------------------------------

def add_band(df: DataFrame) -> DataFrame:
    """Threshold band around ratio 1 (type MAPE or villa zone table) widened/shifted by uncertainty."""
    p, lo, hi = F.col("pred_f"), F.col("lo_f"), F.col("hi_f")
    df = df.withColumn("uncertainty", F.when(p > 0, (hi - lo) / p).otherwise(F.lit(0.0)))
    mape = F.coalesce(_map(R.MAPE_BY_TYPE)[F.col("type_clean")], F.lit(R.DEFAULT_MAPE))
    is_villa = F.col("type_clean") == "Villa"
    zl = F.coalesce(_map({z: t[0] for z, t in R.VILLA_ZONE_THRESHOLDS.items()})[F.col("zone")],
                    F.lit(R.DEFAULT_VILLA_THRESHOLDS[0]))
    zu = F.coalesce(_map({z: t[1] for z, t in R.VILLA_ZONE_THRESHOLDS.items()})[F.col("zone")],
                    F.lit(R.DEFAULT_VILLA_THRESHOLDS[1]))
    lower = F.when(is_villa, zl).otherwise(F.lit(1.0) - mape * R.BAND_MARGIN_SHARE)
    upper = F.when(is_villa, zu).otherwise(F.lit(1.0) + mape * R.BAND_MARGIN_SHARE)
    u = F.col("uncertainty")
    wide, narrow = u > R.WIDE_UNCERTAINTY, u < R.NARROW_UNCERTAINTY
    return df.select(
        "*",
        F.when(wide, lower * R.WIDE_BAND[0]).when(narrow, lower * R.NARROW_BAND[0]).otherwise(lower)
        .alias("band_lower"),
        F.when(wide, upper * R.WIDE_BAND[1]).when(narrow, upper * R.NARROW_BAND[1]).otherwise(upper)
        .alias("band_upper"),
    )


def add_hybrid_alert(df: DataFrame) -> DataFrame:
    """Hard alert from the interval, soft from the ratio band; hard wins unless FAIR."""
    ask, p = F.col("ask"), F.col("pred_f")
    df = df.withColumn("ratio", F.when(p > 0, ask / p).otherwise(F.lit(1.0)))
    hard = F.when(ask < F.col("lo_f"), "UNDERPRICED").when(ask > F.col("hi_f"), "OVERPRICED").otherwise("FAIR")
    r = F.col("ratio")
    soft = F.when(r < F.col("band_lower"), "UNDERPRICED").when(r > F.col("band_upper"), "OVERPRICED") \
            .otherwise("FAIR")
    return df.withColumn("alert_raw", F.when(hard != "FAIR", hard).otherwise(soft))


def add_confidence(df: DataFrame) -> DataFrame:
    """Base by type/zone minus penalties plus signal, times type reliability."""
    t = F.col("type_clean")
    is_villa = t == "Villa"
    zone = F.col("zone")
    villa_base = (F.when(zone.isin("coastal", "red_sea"), F.lit(min(R.BASE_CONFIDENCE["Villa"], R.VILLA_RESORT_CAP)))
                  .when((zone == "urban") & (F.col("developer_level") == "premium"),
                        F.lit(min(R.VILLA_PREMIUM_DEV_CAP, R.BASE_CONFIDENCE["Villa"] + R.VILLA_PREMIUM_DEV_BOOST)))
                  .otherwise(F.lit(R.BASE_CONFIDENCE["Villa"])))
    other_base = F.coalesce(_map(R.BASE_CONFIDENCE)[t], F.lit(R.DEFAULT_BASE_CONFIDENCE))
    other_base = F.when(t == "Duplex", F.least(other_base, F.lit(R.DUPLEX_BASE_CAP))).otherwise(other_base)
    base = F.when(is_villa, villa_base).otherwise(other_base)
    penalty = (
        F.when(F.col("land_size") == "missing",
               F.when(is_villa, R.PENALTY_LAND_MISSING[0]).otherwise(R.PENALTY_LAND_MISSING[1])).otherwise(0)
        + F.when(F.col("in_compound") == "no",
                 F.when(is_villa, R.PENALTY_NOT_COMPOUND[0]).otherwise(R.PENALTY_NOT_COMPOUND[1])).otherwise(0)
        + F.when(F.col("developer_level") == "unknown", R.PENALTY_DEVELOPER_UNKNOWN).otherwise(0)
        + F.when(F.col("uncertainty") > R.WIDE_UNCERTAINTY, R.PENALTY_WIDE_UNCERTAINTY).otherwise(0)
    )
    r, lo, up = F.col("ratio"), F.col("band_lower"), F.col("band_upper")
    below = F.when(lo > 0, (lo - r) / lo).otherwise(F.lit(0.0))
    above = F.when(up > 0, (r - up) / up).otherwise(F.lit(0.0))
    half = (up - lo) / 2
    dist = _clamp(F.abs(r - (lo + up) / 2) / half, 0.0, 1.0)
    boost = (F.when(r < lo, _trunc_int(F.least(below * R.SIGNAL_SLOPE, F.lit(float(R.SIGNAL_CAP)))))
             .when(r > up, _trunc_int(F.least(above * R.SIGNAL_SLOPE, F.lit(float(R.SIGNAL_CAP)))))
             .when(half > 0, -_trunc_int(dist * R.SIGNAL_CAP))
             .otherwise(F.lit(0)))
    df = df.withColumn("conf_pre", _clamp(base - penalty + boost, *R.SCORE_RANGE))
    rel = F.coalesce(_map(R.TYPE_RELIABILITY)[t], F.lit(1.0))
    score = _clamp(_trunc_int(F.col("conf_pre") * rel), *R.SCORE_RANGE)
    df = df.withColumn("conf_score_raw", score)
    s = F.col("conf_score_raw")
    return df.withColumn("conf_level_raw", F.when(s >= R.LEVEL_HIGH, "HIGH").when(s >= R.LEVEL_MEDIUM, "MEDIUM")
                         .otherwise("LOW")).drop("conf_pre")


# ---------------------------------------------------------------------------
# D7-D9 safety layers
# ---------------------------------------------------------------------------

def add_artefact_lookups(df: DataFrame, rarity: DataFrame, pps: DataFrame, pps_gm: DataFrame) -> DataFrame:
    """Left-join rarity and price-per-sqm tables on the trimmed (area, type) key."""
    df = df.withColumn("_k_area", py_strip(F.coalesce(F.col("area").cast("string"), F.lit("nan")))) \
           .withColumn("_k_type", py_strip(F.col("type_clean")))
    r = rarity.select(F.col("city").alias("_k_area"), F.col("type_clean").alias("_k_type"), "rarity")
    p = pps.select(F.col("city").alias("_k_area"), F.col("type_clean").alias("_k_type"), "lpps",
                   F.lit(True).alias("_in_pps"))
    df = (df.join(broadcast_if_small(r), ["_k_area", "_k_type"], "left")
            .join(broadcast_if_small(p), ["_k_area", "_k_type"], "left"))
    return attach_scalars(df, pps_gm.select("pps_gm")).drop("_k_area", "_k_type")


def add_rarity(df: DataFrame) -> DataFrame:
    """Rarity score and penalty."""
    score = F.when(F.col("rarity").isNotNull(), F.col("rarity")) \
             .when(F.col("_in_pps").isNull(), F.lit(R.RARITY_UNKNOWN_KEY)).otherwise(F.lit(0.0))
    df = df.withColumn("rarity_score", score)
    rs = F.col("rarity_score")
    return df.select("*",
                     F.when(rs >= R.RARITY_HIGH_THRESHOLD, R.RARITY_PENALTY_HIGH)
                     .when(rs >= R.RARITY_MED_THRESHOLD, R.RARITY_PENALTY_MED).otherwise(0).alias("rarity_penalty"),
                     (rs >= R.RARITY_MED_THRESHOLD).alias("is_rare"))


def add_benchmark(df: DataFrame) -> DataFrame:
    """Prediction vs exp(median log price per sqm) x size."""
    size = F.col("size_sqm")
    log_pps = F.when(F.col("_in_pps").isNotNull(), F.col("lpps")).otherwise(F.col("pps_gm"))
    expected = F.exp(log_pps) * size
    valid = size.isNotNull() & (size > 0) & expected.isNotNull() & (expected > 0) & ~F.isnan(expected) \
        & (expected != float("inf"))
    df = df.withColumn("benchmark_deviation", F.when(valid, F.col("pred_f") / expected).otherwise(F.lit(1.0)))
    dev = F.col("benchmark_deviation")
    return df.withColumn("is_unrealistic", F.when(valid, (dev > R.BENCHMARK_UPPER) | (dev < R.BENCHMARK_LOWER))
                         .otherwise(F.lit(False)))


def add_safety(df: DataFrame) -> DataFrame:
    """Penalties; extreme ratios keep the alert at LOW, weak data turns it FAIR at LOW."""
    r = F.col("ratio")
    extreme = (r < R.EXTREME_RATIO_LOW) | (r > R.EXTREME_RATIO_HIGH)
    weak = F.col("is_rare") | F.col("is_unrealistic")
    pen = F.col("rarity_penalty") + F.when(F.col("is_unrealistic"), R.BENCHMARK_PENALTY).otherwise(0)
    adj = F.greatest(F.lit(R.SCORE_RANGE[0]), F.col("conf_score_raw") - pen)
    capped = F.least(adj, F.lit(R.SAFETY_SCORE_CAP))
    df = df.select(
        "*",
        F.when(extreme, F.col("alert_raw")).when(weak, F.lit("FAIR")).otherwise(F.col("alert_raw")).alias("alert"),
        F.when(extreme | weak, capped).otherwise(adj).alias("confidence_score"),
    )
    s = F.col("confidence_score")
    level = (F.when(extreme | weak, F.lit("LOW")).when(s < R.LEVEL_MEDIUM, "LOW")
             .when(s < R.LEVEL_HIGH, "MEDIUM").otherwise("HIGH"))
    return df.withColumn("confidence", level)


# ---------------------------------------------------------------------------
# D10-D12 texts
# ---------------------------------------------------------------------------

def _filled(template: str, **values: Column) -> Column:
    """A fixed sentence with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def add_reason(df: DataFrame) -> DataFrame:
    """English reason + Arabic two-line explanation + optional notes."""
    low, high = fmt.price_egp(F.col("lo_f")), fmt.price_egp(F.col("hi_f"))
    df = df.withColumn("_low", low).withColumn("_high", high)
    low, high = F.col("_low"), F.col("_high")
    r = F.col("ratio")
    dev = F.abs(r - 1.0) * 100
    below = r < 1.0
    pct = F.when(below, _clamp(_trunc_int((1.0 - r) * 100), 1, 50)).otherwise(_clamp(_trunc_int((r - 1.0) * 100), 1, 50))
    direction = F.when(below, F.lit("below")).otherwise(F.lit("above"))
    range_ = {"low": low, "high": high}
    position = _filled(R.REASON_POSITION, end=F.when(below, F.lit(R.REASON_LOWEST)).otherwise(F.lit(R.REASON_HIGHEST)), pct=pct.cast("string"))

    def told(word: str) -> Column:
        strong = _filled(R.REASON_STRONG, word=F.lit(word), dev=fmt.fixed(dev, 0), direction=direction, position=position, **range_)
        return F.when(dev >= R.REASON_STRONG_FROM, strong).otherwise(_filled(R.REASON_MILD, word=F.lit(word), **range_))

    alert = F.col("alert")
    interpret = (F.when(alert == "UNDERPRICED", told("lower")).when(alert == "OVERPRICED", told("higher"))
                 .otherwise(_filled(R.REASON_FAIR, **range_)))
    area = F.col("area").cast("string")
    area_str = F.when(area.isNotNull() & (area != "") & (area != "Unknown"), area).otherwise(F.lit(R.AREA_FALLBACK_TEXT))
    prefix = F.coalesce(_map(R.ZONE_PREFIX)[F.col("zone")], F.lit(""))
    english = _filled(R.REASON_ENGLISH, prefix=prefix, type=F.lower(F.col("type_clean")), area=area_str, interpretation=interpret,
                      note=F.when(F.col("calibrated"), F.lit(R.REASON_STANDALONE_NOTE)).otherwise(F.lit("")), **range_)

    def ar(template: str) -> Column:
        return _filled(template, lo=low, hi=high)

    line1 = (F.when(alert == "UNDERPRICED", F.when(r < R.EXTREME_RATIO_LOW, ar(R.AR_UNDER_EXTREME))
                    .otherwise(ar(R.AR_UNDER)))
             .when(alert == "OVERPRICED", F.when(r > R.EXTREME_RATIO_HIGH, ar(R.AR_OVER_EXTREME))
                   .otherwise(ar(R.AR_OVER)))
             .otherwise(ar(R.AR_FAIR)))
    lvl = F.col("confidence")
    weak = F.col("is_rare") | F.col("is_unrealistic")
    line2 = (F.when(weak & (lvl == "LOW"), F.lit(R.AR_WEAK_DATA)).when(lvl == "LOW", F.lit(R.AR_LOW))
             .when(lvl == "MEDIUM", F.lit(R.AR_MEDIUM)).otherwise(F.lit(R.AR_HIGH)))
    notes = F.concat_ws(" ", F.when(F.col("has_pool") == "yes", F.lit(R.REASON_POOL_NOTE)),
                        F.when(F.col("developer_level") == "premium", F.lit(R.REASON_DEVELOPER_NOTE)))
    reason = F.concat(english, F.lit("\n\n"), line1, F.lit("\n"), line2,
                      F.when(notes != "", F.concat(F.lit(" "), notes)).otherwise(F.lit("")))
    return df.withColumn("reason", reason).drop("_low", "_high")


def down_payment_warning_col(ask: Column, pred: Column) -> Column:
    """Warn when the ask looks like a down payment (ratio < 0.35)."""
    ratio = F.when(pred > 0, ask / pred).otherwise(F.lit(1.0))
    guess = pred * R.DOWN_PAYMENT_GUESS_SHARE
    text = _filled(R.DOWN_PAYMENT_WARNING, ask=fmt.price_egp(ask), share=fmt.fixed(ratio * 100, 0), guess=fmt.price_egp(guess))
    return F.when(ratio < R.DOWN_PAYMENT_SUSPECT_RATIO, text)


def coverage_score_col(df: DataFrame) -> Column:
    """Weighted count of the information a listing carries (0..100, 50 when nothing is known)."""
    amen = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in R.COVERAGE_AMENITIES]) > 0
    financial = (F.col("down_payment_ratio").isNotNull() | (F.coalesce(F.col("is_installment"), F.lit(0)) == 1)
                 | (F.coalesce(F.col("is_cash"), F.lit(0)) == 1))
    present = {
        "building_age": F.col("building_age").isNotNull(),
        "floor_level": F.col("floor_level").isNotNull(),
        "amenities": amen,
        "condition_score": F.col("condition_score").isNotNull(),
        "view_score": F.coalesce(F.col("view_score"), F.lit(0.0)) > 0,
        "financial_info": financial,
    }
    total = sum((F.when(v, F.lit(R.COVERAGE_WEIGHTS.get(k, R.COVERAGE_OTHER_WEIGHT))).otherwise(0)
                 for k, v in present.items()), F.lit(0))
    return F.least(total, F.lit(R.COVERAGE_CAP)).cast("double")


# ---------------------------------------------------------------------------
# D14 full decision, D16 listing attributes, D17 quick valuation, D18 request alignment
# ---------------------------------------------------------------------------

def decide(df: DataFrame, rarity: DataFrame, pps: DataFrame, pps_gm: DataFrame,
           keep_intermediate: bool = False, legacy_note: bool = False) -> DataFrame:
    """Bias, calibration, villa zone, band, hybrid alert, confidence, safety, reason.

    The standalone note appears where the standalone discount (D2) changed the price; ``legacy_note`` also shows it
    where only the bias factor did.
    """
    cols = df.columns
    out = add_bias_correction(df)
    out = add_standalone_calibration(out)
    calibrated = F.col("pred_c") != F.col("pred_b")
    out = out.withColumn("calibrated", calibrated | (F.col("pred_b") != F.col("pred")) if legacy_note else calibrated)
    out = add_villa_correction(out)
    out = add_band(out)
    out = add_hybrid_alert(out)
    out = add_confidence(out)
    out = add_artefact_lookups(out, rarity, pps, pps_gm)
    out = add_rarity(out)
    out = add_benchmark(out)
    out = add_safety(out)
    out = add_reason(out)
    out = out.withColumn("down_payment_warning", down_payment_warning_col(F.col("ask"), F.col("pred")))
    if keep_intermediate:
        return out
    return out.select(*cols, "alert", "confidence", "confidence_score", "reason", "ratio", "zone",
                      "down_payment_warning")


def listing_attributes(df: DataFrame, desc: str = "description", city: str = "city",
                       location: str = "location", is_compound: str = "is_compound",
                       size: str = "size_sqm") -> DataFrame:
    """Decision inputs derived from a listing (pool, developer, area fallback, land size)."""
    d = F.lower(F.coalesce(F.col(desc), F.lit("")))
    last_part = py_strip(F.element_at(F.split(F.coalesce(F.col(location), F.lit("nan")), ",", -1), -1))
    fallback = F.when(F.col(location).isNull() | (last_part == ""), F.lit("Unknown")).otherwise(last_part)
    area = F.when(F.col(city) == "Unknown", fallback).otherwise(F.col(city))
    return df.select(
        "*",
        area.alias("area"),
        F.when(F.col(size).isNotNull(), "present").otherwise("missing").alias("land_size"),
        F.when(F.col(is_compound) == 1, "yes").otherwise("no").alias("in_compound"),
        F.when(contains_any(d, R.POOL_WORDS), "yes").otherwise("no").alias("has_pool"),
        F.when(contains_any(d, R.PREMIUM_DEVELOPERS), "premium").otherwise("unknown").alias("developer_level"),
    )


def quick_valuation(df: DataFrame, ask: str = "ask", size: str = "size_sqm", pred: str = "pred") -> DataFrame:
    """Predicted price (fallback size x 36,500), +-10 % range in millions, GOOD DEAL/FAIR/OVERPRICED, reason.

    The reason is NULL where there is neither a prediction nor a size.
    """
    p = F.col(pred)
    value = F.when(p.isNotNull() & (p > 0), p).otherwise(F.col(size) * R.FALLBACK_PRICE_PER_SQM)
    df = df.withColumn("quick_pred", value)
    v = F.col("quick_pred")
    lo, hi = [fmt.fixed(v * share / 1_000_000, 2) for share in R.QUICK_RANGE]
    shortest = [F.regexp_replace(x, "0$", "") for x in (lo, hi)]  # 1.20 as 1.2, 1.00 as 1.0
    before, between, after = R.QUICK_REASON.replace("{hi}", "{lo}").split("{lo}")
    reason = F.concat(F.lit(before), shortest[0], F.lit(between), shortest[1], F.lit(after))
    alert = (F.when(F.col(ask) < v * R.QUICK_GOOD_DEAL, "GOOD DEAL")
             .when(F.col(ask) > v * R.QUICK_OVERPRICED, "OVERPRICED").otherwise("FAIR"))
    return df.select("*", lo.cast("double").alias("min_range_m"), hi.cast("double").alias("max_range_m"),
                     alert.alias("quick_alert"), reason.alias("quick_reason"))


def align_request(df: DataFrame, feature_names: list[str], bedrooms: str = "bedrooms",
                  bathrooms: str = "bathrooms", size: str = "size_sqm", amenities: str = "amenities") -> DataFrame:
    """Fill a model's feature columns from a request by name; unmatched features are 0."""
    out = []
    for name in feature_names:
        n = name.lower()
        if "bedroom" in n:
            v = F.col(bedrooms).cast("double")
        elif "bathroom" in n:
            v = F.col(bathrooms).cast("double")
        elif "size" in n or "sqm" in n:
            v = F.col(size).cast("double")
        elif "amenit" in n:
            v = F.coalesce(F.size(F.col(amenities)), F.lit(0)).cast("double")
        else:
            v = F.lit(0.0)
        out.append(v.alias(name))
    return df.select("*", *out)

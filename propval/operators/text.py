"""Description features (T1-T18) as native column expressions.

The lower-cased description is staged once as a column (``_d``) so each of
the ~100 patterns reads it instead of re-lowering the text; the flags are then
emitted in one projection. NULL text counts as the empty string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.functions import rules as R
from propval.functions.regex import (ascii_digits, col_of, count, extract, flag, has, java, last_wins)

CONTENT_COLUMNS = (
    ["building_age", "under_construction", "floor_level", "has_explicit_floor", "legal_status",
     "condition_score"]
    + [n for n, _ in R.AMENITY_FLAGS] + [n for n, _ in R.MICRO_LOCATION_FLAGS]
    + [n for n, _ in R.MOTIVATION_FLAGS] + ["motivation_score"]
    + [n for n, _ in R.EXPOSURE_FLAGS] + [n for n, _ in R.ROOM_CONFIG_FLAGS]
    + ["has_phone_in_desc", "caps_ratio", "excl_count", "sentence_count", "num_count"]
)
KW_COLUMNS = ["nlp_" + n for n, _ in R.KWS] + ["desc_len", "nlp_score"]
SEMANTIC_COLUMNS = ["luxury_score", "budget_score", "investment_signal"]


# ---------------------------------------------------------------------------
# T1-T3 keyword flags and scores (text lowered, URLs stripped again)
# ---------------------------------------------------------------------------

def add_keyword_flags(df: DataFrame, desc: str = "desc_clean") -> DataFrame:
    """18 nlp_* flags, desc_len = clip(len/500, 0, 4), nlp_score = flags + desc_len."""
    df = df.withColumn("_k", F.regexp_replace(F.lower(F.coalesce(F.col(desc), F.lit(""))),
                                              java(R.URL_PATTERN), " "))
    k = "_k"
    flags = [flag(k, p).alias("nlp_" + n) for n, p in R.KWS]
    desc_len = F.least(F.greatest(F.char_length(F.col(k)) / R.DESC_LEN_DIVISOR, F.lit(0.0)),
                       F.lit(float(R.DESC_LEN_CAP)))
    df = df.select("*", *flags, desc_len.alias("desc_len"))
    score = sum((F.col("nlp_" + n) for n, _ in R.KWS), F.lit(0)) + F.col("desc_len")
    return df.withColumn("nlp_score", score).drop("_k")


def add_semantic_scores(df: DataFrame, desc: str = "desc_clean") -> DataFrame:
    """Luxury / budget / investment term counts (non-overlapping matches)."""
    df = df.withColumn("_k", F.regexp_replace(F.lower(F.coalesce(F.col(desc), F.lit(""))),
                                              java(R.URL_PATTERN), " "))
    k = F.col("_k")
    return df.select("*", count(k, R.LUXURY_TERMS).cast("double").alias("luxury_score"),
                     count(k, R.BUDGET_TERMS).cast("double").alias("budget_score"),
                     count(k, R.INVEST_TERMS).cast("double").alias("investment_signal")).drop("_k")


# ---------------------------------------------------------------------------
# T4-T13 content extractors
# ---------------------------------------------------------------------------

def _year(c: Column) -> Column:
    return ascii_digits(c).try_cast("double")


def building_age_cols(d: Column) -> list[Column]:
    """T4: age from a delivery year (anchor 2026) or 'N years old'; 0..100 else NULL."""
    delivery = F.coalesce(_year(extract(d, R.DELIVERY_YEAR_AFTER)), _year(extract(d, R.DELIVERY_YEAR_BEFORE)))
    from_text = _year(extract(d, R.AGE_IN_YEARS))
    age = F.coalesce(F.lit(float(R.ANCHOR_YEAR)) - delivery, from_text)
    age = F.when((age >= R.AGE_RANGE[0]) & (age <= R.AGE_RANGE[1]), age)
    return [age.alias("building_age"), flag(d, R.UNDER_CONSTRUCTION).alias("under_construction")]


def floor_cols(d: Column) -> list[Column]:
    """T5: phrase floor (last wins), else first numeric floor; clip 0..50."""
    phrase = last_wins(d, R.FLOOR_RULES, None).cast("double")
    g1 = extract(d, R.FLOOR_NUMBER, 1)
    g2 = extract(d, R.FLOOR_NUMBER, 2)
    numeric = _year(F.coalesce(g1, g2))
    level = F.coalesce(phrase, numeric)
    return [F.least(F.greatest(level, F.lit(float(R.FLOOR_RANGE[0]))), F.lit(float(R.FLOOR_RANGE[1]))).alias("floor_level"),
            level.isNotNull().cast("int").alias("has_explicit_floor")]


def content_cols(d: Column, raw: Column) -> list[Column]:
    """T4-T13 (37 columns). ``d`` is the lower-cased text, ``raw`` the original case."""
    cols = building_age_cols(d) + floor_cols(d)
    cols.append(last_wins(d, R.LEGAL_RULES, 0).cast("int").alias("legal_status"))
    cols.append(last_wins(d, R.CONDITION_RULES, None).cast("double").alias("condition_score"))
    for group in (R.AMENITY_FLAGS, R.MICRO_LOCATION_FLAGS, R.MOTIVATION_FLAGS):
        cols += [flag(d, p).alias(n) for n, p in group]
    motivation = {n: p for n, p in R.MOTIVATION_FLAGS}
    cols.append(sum((flag(d, motivation[n]) for n in R.MOTIVATION_SCORE_PARTS), F.lit(0))
                .alias("motivation_score"))
    for group in (R.EXPOSURE_FLAGS, R.ROOM_CONFIG_FLAGS):
        cols += [flag(d, p).alias(n) for n, p in group]
    n_chars = F.char_length(col_of(raw))
    cols += [
        flag(raw, R.PHONE_PATTERN).alias("has_phone_in_desc"),
        (count(raw, R.CAPS_PATTERN) / F.greatest(n_chars, F.lit(1))).alias("caps_ratio"),
        F.least(count(raw, R.EXCL_PATTERN), F.lit(R.EXCL_CAP)).alias("excl_count"),
        F.least(F.greatest(count(raw, R.SENTENCE_PATTERN), F.lit(R.SENTENCE_RANGE[0])),
                F.lit(R.SENTENCE_RANGE[1])).alias("sentence_count"),
        F.least(count(raw, R.DIGIT_PATTERN), F.lit(R.DIGIT_CAP)).alias("num_count"),
    ]
    return cols


def add_content_features(df: DataFrame, desc: str = "desc_clean") -> DataFrame:
    """All 37 content columns in one projection over a staged lower-case text."""
    df = df.withColumn("_raw", F.coalesce(F.col(desc), F.lit("")))
    df = df.withColumn("_d", F.lower(F.col("_raw")))
    return df.select("*", *content_cols("_d", "_raw")).drop("_d", "_raw")


def add_text_meta(df: DataFrame, text: str) -> DataFrame:
    """T13 alone (phone-like, caps ratio, '!' / sentence / digit counts) over any text column."""
    df = df.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))
    meta = content_cols("_raw", "_raw")[-5:]
    return df.select("*", *meta).drop("_raw")


# ---------------------------------------------------------------------------
# T15-T18 rental amenity features (aliases + optional checkbox map)
# ---------------------------------------------------------------------------

def normalize_variants_col(c: Column) -> Column:
    """Lower-case then replace spelling variants in their fixed order."""
    s = F.lower(F.coalesce(c, F.lit("")))
    for variant, canonical in R.ARABIC_VARIANTS:
        s = F.replace(s, F.lit(variant.lower()), F.lit(canonical.lower()))
    return s


def alias_pattern(aliases: list[str]) -> str:
    """One alternation: short aliases (<= 4 chars) need separators around them."""
    parts = []
    for a in aliases:
        esc = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", a.lower())  # only what a pattern reads as more than itself
        parts.append(rf"(?:^|\s){esc}(?:$|\s|\.|,|!)" if len(a) <= R.SHORT_ALIAS_MAX_LEN else esc)
    return "|".join(parts)


def add_rental_features(df: DataFrame, desc: str = "description", checkboxes: str | None = None) -> DataFrame:
    """Per-feature flag and source (checkbox / nlp / none), weighted score, breakdown.

    ``checkboxes`` names an optional ``map<string,string>`` column; a present,
    non-NULL entry overrides the text ('yes', 'true', '1', 'on' mean true).
    """
    df = df.withColumn("_norm", normalize_variants_col(F.col(desc)))
    n = "_norm"
    flags, sources = [], []
    for feat, aliases in R.FEATURE_ALIASES.items():
        nlp = has(n, alias_pattern(aliases))
        if checkboxes:
            box = F.col(checkboxes)[F.lit(feat)]
            val = F.when(box.isNotNull(), F.lower(box).isin(*R.CHECKBOX_TRUE)).otherwise(nlp)
            src = F.when(box.isNotNull(), F.lit("checkbox")).when(nlp, F.lit("nlp")).otherwise(F.lit("none"))
        else:
            val = nlp
            src = F.when(nlp, F.lit("nlp")).otherwise(F.lit("none"))
        flags.append(val.cast("int").alias(f"feat_{feat}"))
        sources.append(src.alias(f"src_{feat}"))
    df = df.select("*", *flags, *sources).drop("_norm")
    feats = list(R.FEATURE_ALIASES)
    score = sum((F.col(f"feat_{f}") * F.lit(R.FEATURE_WEIGHTS.get(f, 0)) for f in feats), F.lit(0))
    active = F.filter(F.array(*[F.when(F.col(f"feat_{f}") == 1, F.lit(f)) for f in feats]),
                      lambda x: x.isNotNull())
    entries = F.filter(
        F.array(*[F.struct(F.lit(f).alias("k"), F.lit(R.FEATURE_WEIGHTS.get(f, 0)).alias("v"),
                           F.col(f"feat_{f}").alias("on")) for f in feats]),
        lambda s: s["on"] == 1)
    breakdown = F.map_from_entries(F.transform(entries, lambda s: F.struct(s["k"], s["v"])))
    return df.select("*", score.cast("int").alias("feature_score"), active.alias("active_features"),
                     breakdown.alias("feature_breakdown"))


def feature_columns() -> list[str]:
    return [f"feat_{f}" for f in R.FEATURE_ALIASES]


def source_columns() -> list[str]:
    return [f"src_{f}" for f in R.FEATURE_ALIASES]

"""Listing cleaning: parsers and derived columns.

Every function takes a DataFrame and column names and returns a DataFrame
with added columns. All work is native Column expressions (regex, casts,
``when`` chains), so the cleaning pass is one codegen'd projection per stage.
Semantics follow Python/pandas: missing text behaves like the string 'nan'
where the original stringified a value, NULL numerics stay NULL (never NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.functions import rules as R
from propval.functions.regex import (ascii_digits, col_of, contains_any, extract, first_wins,
                                     has, java, last_wins, py_round, py_str, py_strip)


# ---------------------------------------------------------------------------
# Column builders (used by the DataFrame operators below and by streaming)
# ---------------------------------------------------------------------------

def to_float_col(c) -> Column:
    """Drop everything but digits and dots, then parse; bad text -> NULL."""
    digits = F.regexp_replace(ascii_digits(py_str(c)), r"[^0-9.]", "")
    return digits.try_cast("double")


def _number(group: Column) -> Column:
    return F.regexp_replace(ascii_digits(group), ",", "").try_cast("double")


def size_text_col(c) -> Column:
    """Lower-cased size text with exotic spaces turned into plain spaces."""
    s = py_strip(F.lower(py_str(c)))
    return py_strip(F.regexp_replace(s, f"[{R.SIZE_SPACE_CHARS}]", " "))


def _size_from_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Staged so the normalised text and each parsed number are computed once."""
    t = F.col(text)
    df = df.select("*", has(t, R.SIZE_SQM).alias("_is_sqm"), has(t, R.SIZE_SQFT).alias("_is_sqft"),
                   has(t, R.SIZE_BARE).alias("_is_bare"),
                   F.regexp_extract(t, java(R.SIZE_SQM), 1).alias("_g_sqm"),
                   F.regexp_extract(t, java(R.SIZE_SQFT), 1).alias("_g_sqft"),
                   F.regexp_extract(t, java(R.SIZE_BARE), 1).alias("_g_bare"))
    v = (F.when(F.col("_is_sqm"), _number(F.col("_g_sqm")))
         .when(F.col("_is_sqft"), _number(F.col("_g_sqft")) * F.lit(R.SQFT_TO_SQM))
         .when(F.col("_is_bare"), _number(F.col("_g_bare"))))
    df = df.withColumn("_v", v)
    in_range = (F.col("_v") >= R.SIZE_MIN) & (F.col("_v") <= R.SIZE_MAX)
    res = F.when(F.col("_is_sqm") | F.col("_is_sqft"), F.when(in_range, py_round(F.col("_v"), 1))) \
        .when(F.col("_is_bare"), F.when(in_range, F.col("_v")))
    return df.withColumn(out, res).drop("_is_sqm", "_is_sqft", "_is_bare", "_g_sqm", "_g_sqft",
                                        "_g_bare", "_v")


def first_int_col(c) -> Column:
    return extract(ascii_digits(py_str(c)), r"(\d+)").try_cast("double")


def numeric_col(c) -> Column:
    return py_strip(ascii_digits(col_of(c))).try_cast("double")


def down_payment_col(c) -> Column:
    s = F.regexp_replace(F.lower(col_of(c)), ",", "")
    mult = F.when(has(s, R.DP_MILLION), F.lit(1e6)).when(has(s, R.DP_THOUSAND), F.lit(1e3)).otherwise(F.lit(1.0))
    num = extract(ascii_digits(s), r"(\d+(?:\.\d+)?)").try_cast("double")
    return F.when(col_of(c).isNotNull(), num * mult)


def desc_clean_col(c) -> Column:
    text = F.coalesce(col_of(c), F.lit(""))
    return F.when(has(text, R.URL_PATTERN), F.regexp_replace(text, java(R.URL_PATTERN), " ")).otherwise(text)


def location_cols(c) -> tuple[Column, Column, Column]:
    parts = F.split(col_of(c), ",", -1)
    n = F.size(parts)
    first = F.element_at(parts, 1)
    missing = col_of(c).isNull()
    unknown = F.lit("Unknown")
    # only the parts that are taken are stripped
    compound = F.when(missing, unknown).otherwise(py_strip(first))
    city = F.when(missing, unknown).otherwise(py_strip(F.when(n >= 3, F.element_at(parts, -2)).otherwise(first)))
    gov = F.when(missing, unknown).otherwise(py_strip(F.when(n >= 2, F.element_at(parts, -1)).otherwise(first)))
    return compound, city, gov


def market_tier_col(gov, city, compound) -> Column:
    blob = F.concat_ws(" ", F.lower(py_str(gov)), F.lower(py_str(city)), F.lower(py_str(compound)))
    return first_wins(blob, R.MARKET_TIER_RULES, 0.0)


def zone_col(*parts) -> Column:
    """urban / coastal / red_sea from a lower-cased blob of the given columns."""
    blob = F.concat_ws(" ", *[F.lower(py_str(p)) for p in parts])
    return (F.when(has(blob, R.COASTAL_PATTERNS), F.lit("coastal"))
            .when(has(blob, R.RED_SEA_PATTERNS), F.lit("red_sea"))
            .otherwise(F.lit("urban")))


def zone_ordinal_col(zone) -> Column:
    m = F.create_map(*[x for k, v in R.ZONE_ORDINAL.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col_of(zone)], F.lit(0.0))


def size_bucket_col(size) -> Column:
    s = col_of(size)
    expr = None
    for bound, label in R.SIZE_BUCKETS:
        expr = F.when(s < bound, F.lit(label)) if expr is None else expr.when(s < bound, F.lit(label))
    return expr.otherwise(F.lit(R.SIZE_BUCKET_TOP))


def normalized_type_col(c) -> Column:
    """Canonical type name or NULL when the type is not supported."""
    entries = {}
    for name in R.ALLOWED_TYPES:
        entries[name.lower()] = name
    for ar, en in R.ARABIC_TYPE_NAMES.items():
        entries[ar] = en
    for v in R.VILLA_VARIANTS:
        entries[v.lower()] = "Villa"
    m = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.lit(v))])
    return m[F.lower(py_strip(py_str(c)))]


def description_text_col(c) -> Column:
    """Generic cleaner: drop URLs and symbols, keep word chars, spaces and Arabic."""
    s = F.regexp_replace(F.coalesce(col_of(c), F.lit("")), java(r"http\S+|www\S+|https\S+"), "")
    s = F.regexp_replace(s, java(r"[^\w\s؀-ۿ]"), " ")
    s = F.regexp_replace(s, java(r"[\s\x1c-\x1f]+"), " ")
    return py_strip(s)


# ---------------------------------------------------------------------------
# DataFrame operators
# ---------------------------------------------------------------------------

def add_listing_type(df: DataFrame, url: str = "url", out: str = "listing_type") -> DataFrame:
    """C1: 'rent' if the URL carries the rent path, else 'buy'."""
    is_rent = F.lower(py_str(url)).contains(R.RENT_URL_MARK)
    return df.withColumn(out, F.when(is_rent, "rent").otherwise("buy"))


def add_price(df: DataFrame, price: str = "price", out: str = "price_egp",
              drop_invalid: bool = True) -> DataFrame:
    """Numeric price; rows whose price does not parse are dropped."""
    df = df.withColumn(out, to_float_col(price))
    return df.where(F.col(out).isNotNull()) if drop_invalid else df


def add_size(df: DataFrame, size: str = "size", out: str = "size_sqm") -> DataFrame:
    """Area in sqm, 5..5000 only; sqft converted; 1 decimal like Python round."""
    df = df.withColumn("_size_text", size_text_col(size))
    return _size_from_text(df, "_size_text", out).drop("_size_text")


def add_rooms(df: DataFrame, bedrooms: str = "bedrooms", bathrooms: str = "bathrooms") -> DataFrame:
    """Bedroom count (first digit run), bathroom count (whole value), maid flag."""
    return df.select(
        "*",
        first_int_col(bedrooms).alias("bedrooms_n"),
        numeric_col(bathrooms).alias("bathrooms_n"),
        F.lower(F.coalesce(F.col(bedrooms), F.lit(""))).contains("maid").cast("int").alias("has_maid"),
    )


def add_payment_flags(df: DataFrame, payment: str = "payment_method") -> DataFrame:
    """Installment and cash flags from the payment text."""
    pay = F.lower(F.coalesce(F.col(payment), F.lit("")))
    return df.select("*", has(pay, R.INSTALLMENT_WORDS).cast("int").alias("is_installment"),
                     has(pay, R.CASH_WORDS).cast("int").alias("is_cash"))


def add_down_payment(df: DataFrame, down_payment: str = "down_payment",
                     price: str = "price_egp") -> DataFrame:
    """Parsed down payment, ratio to price kept in (0, 1), log amount."""
    if down_payment not in df.columns:
        df = df.withColumn(down_payment, F.lit(None).cast("string"))
    dp = down_payment_col(down_payment)
    df = df.withColumn("_dp", dp)
    ratio = F.try_divide(F.col("_dp"), F.col(price))
    return (df.withColumn("down_payment_ratio", F.when((ratio > 0) & (ratio < 1.0), ratio))
              .withColumn("log_down_payment",
                          F.when(F.col("_dp").isNotNull(), F.log1p(F.greatest(F.col("_dp"), F.lit(0.0)))))
              .drop("_dp"))


def add_type_and_text(df: DataFrame, type_col: str = "type", description: str = "description") -> DataFrame:
    """Raw type with 'Other' default; description without URLs."""
    return df.select("*", F.coalesce(F.col(type_col), F.lit("Other")).alias("type_clean"),
                     desc_clean_col(description).alias("desc_clean"))


def add_room_ratio(df: DataFrame) -> DataFrame:
    """Bathrooms per bedroom (0 bedrooms -> NULL)."""
    return df.withColumn("room_ratio", F.try_divide(F.col("bathrooms_n"), F.nullif(F.col("bedrooms_n"), F.lit(0.0))))


def add_location(df: DataFrame, location: str = "location") -> DataFrame:
    """Compound / city / governorate from a comma list."""
    compound, city, gov = location_cols(location)
    return df.select("*", compound.alias("compound"), city.alias("city"), gov.alias("governorate"))


def add_install_years(df: DataFrame, desc: str = "desc_clean") -> DataFrame:
    """C14: first 'N year' in the description, kept when 2..25."""
    low = F.lower(F.col(desc))
    yr = F.when(has(low, "year"), extract(ascii_digits(low), R.INSTALL_YEARS).try_cast("double"))
    return df.withColumn("install_years",
                         F.when((yr >= R.INSTALL_YEARS_MIN) & (yr <= R.INSTALL_YEARS_MAX), yr))


def add_finish_view(df: DataFrame, desc: str = "desc_clean") -> DataFrame:
    """Finish ordinal (NULL default) and view score (0 default), last match wins."""
    df = _staged(df, "_fv_d", F.lower(F.col(desc)))
    d = "_fv_d"
    return df.select("*", last_wins(d, R.FINISH_RULES, None).cast("double").alias("finish_ord"),
                     last_wins(d, R.VIEW_RULES, 0.0).cast("double").alias("view_score")).drop("_fv_d")


def _staged(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Materialise a derived text once as a column so each rule scans it without recomputing it."""
    return df.withColumn(name, expr)


def add_market_tier(df: DataFrame) -> DataFrame:
    """C17: 3 coastal / 2 premium city / 1 old city / 0."""
    blob = F.concat_ws(" ", *[F.lower(py_str(c)) for c in ("governorate", "city", "compound")])
    df = _staged(df, "_tier_blob", blob)
    return df.withColumn("market_tier", first_wins("_tier_blob", R.MARKET_TIER_RULES, 0.0)).drop("_tier_blob")


def add_market_zone(df: DataFrame, desc: str = "desc_clean") -> DataFrame:
    """Area market zone and its ordinal."""
    df = _staged(df, "_zone_blob", F.concat_ws(" ", *[F.lower(py_str(p)) for p in ("city", "compound", desc)]))
    z = "_zone_blob"
    zone = (F.when(has(z, R.COASTAL_PATTERNS), F.lit("coastal")).when(has(z, R.RED_SEA_PATTERNS), F.lit("red_sea"))
            .otherwise(F.lit("urban")))
    df = df.withColumn("area_market_zone", zone).drop("_zone_blob")
    return df.withColumn("area_market_zone_ord", zone_ordinal_col("area_market_zone"))


def add_compound_features(df: DataFrame, compound: str = "compound", desc: str = "desc_clean") -> DataFrame:
    """Compound vs standalone, compound tier, premium interactions."""
    df = _staged(_staged(df, "_cf_comp", F.lower(py_strip(F.coalesce(F.col(compound), F.lit(""))))),
                 "_cf_d", F.lower(F.coalesce(F.col(desc), F.lit(""))))
    comp, d = "_cf_comp", "_cf_d"
    known = F.col(comp).isin(*(R.KNOWN_LUXURY_COMPOUNDS + R.KNOWN_MID_COMPOUNDS))
    compound_signal = known | has(comp, R.COMPOUND_WORD) | has(d, R.COMPOUND_WORD)
    standalone = (F.col(comp).isin(*R.EMPTY_COMPOUND_NAMES) | F.col(compound).isNull()
                  | (F.char_length(F.col(comp)) < 3)
                  | contains_any(comp, R.STANDALONE_KEYWORDS) | contains_any(d, R.STANDALONE_KEYWORDS))
    is_compound = (compound_signal & ~standalone).cast("int")
    lux = F.col(comp).isin(*R.KNOWN_LUXURY_COMPOUNDS) | contains_any(d, R.KNOWN_LUXURY_COMPOUNDS)
    mid = F.col(comp).isin(*R.KNOWN_MID_COMPOUNDS) | contains_any(d, R.KNOWN_MID_COMPOUNDS)
    tier = F.when(lux, F.lit(2.0)).when(mid, F.lit(1.0)).otherwise(F.lit(0.0))
    df = df.select("*", is_compound.alias("is_compound"), tier.alias("compound_tier"))
    return df.select(
        "*",
        ((F.col("is_compound") == 0) & (F.col("market_tier") >= 2.0)).cast("int").alias("standalone_premium"),
        ((F.col("is_compound") == 1) & (F.col("compound_tier") == 2.0)).cast("int").alias("compound_premium"),
    ).drop("_cf_comp", "_cf_d")


def add_size_features(df: DataFrame, size: str = "size_sqm") -> DataFrame:
    """Log size, inverse size, size per bedroom, size x finish, size bucket."""
    s = F.col(size)
    floor1 = F.when(s.isNotNull(), F.greatest(s, F.lit(1.0)))
    return df.select(
        "*",
        F.log1p(floor1).alias("log_size_sqm"),
        (F.lit(1.0) / floor1).alias("size_sqm_inv"),
        F.try_divide(s, F.nullif(F.col("bedrooms_n"), F.lit(0.0))).alias("size_per_bedroom"),
        (F.coalesce(s, F.lit(0.0)) * F.coalesce(F.col("finish_ord"), F.lit(0.0))).alias("size_x_finish"),
        size_bucket_col(s).alias("size_bucket"),
    )


def fix_mislabeled_types(df: DataFrame, type_col: str = "type_clean", desc: str = "desc_clean",
                         size: str = "size_sqm") -> DataFrame:
    """Keyword repair of rows typed 'Apartment'; later rules overwrite earlier ones."""
    df = _staged(df, "_fx_d", F.lower(F.coalesce(F.col(desc), F.lit(""))))
    d = "_fx_d"
    apt = F.col(type_col) == "Apartment"
    big = F.coalesce(F.col(size) > R.VILLA_MIN_SIZE, F.lit(False))
    new_type = (F.when(apt & has(d, R.VILLA_WORDS) & big, F.lit("Villa"))
                .when(apt & has(d, R.DUPLEX_WORDS), F.lit("Duplex"))
                .when(apt & has(d, R.PENTHOUSE_WORDS), F.lit("Penthouse"))
                .otherwise(F.col(type_col)))
    return df.withColumn(type_col, new_type).drop("_fx_d")


def add_interaction_keys(df: DataFrame) -> DataFrame:
    """String keys used by target encodings."""
    comp = F.col("is_compound").cast("string")
    return df.select("*", F.concat(F.col("city"), F.lit("_comp"), comp).alias("city_comp"),
                     F.concat(F.col("governorate"), F.lit("_comp"), comp).alias("governorate_comp"))


def add_encoding_keys(df: DataFrame) -> DataFrame:
    """C28 (second half): combined keys for the combo encodings."""
    t = F.col("type_clean")
    bed = F.coalesce(F.col("bedrooms_n"), F.lit(0.0)).cast("bigint").cast("string")
    fin = F.coalesce(F.col("finish_ord"), F.lit(-1.0)).cast("bigint").cast("string")
    nc = has(F.lower(F.col("desc_clean")), R.NORTH_COAST_PATTERN).cast("int").cast("string")
    return df.select(
        "*",
        F.concat_ws("_", F.col("compound"), t).alias("comp_type"),
        F.concat_ws("_", bed, t).alias("bed_type"),
        F.concat_ws("_", nc, t).alias("nc_type"),
        F.concat_ws("_", fin, t).alias("finish_type"),
        F.concat_ws("_", t, F.col("market_tier").cast("bigint").cast("string")).alias("type_tier"),
    )


def normalize_types(df: DataFrame, type_col: str = "type_clean") -> DataFrame:
    """Canonical type names (NULL when unsupported)."""
    return df.withColumn(type_col, normalized_type_col(type_col))


def filter_supported_types(df: DataFrame, type_col: str = "type_clean") -> DataFrame:
    """Keep the five supported types, normalised."""
    norm = normalized_type_col(type_col)
    return df.withColumn(type_col, norm).where(F.col(type_col).isNotNull())


def quarantine_unsupported(df: DataFrame, type_col: str = "type_clean") -> DataFrame:
    """Side output of rows with unsupported types, with a reason."""
    norm = normalized_type_col(type_col)
    supported = ", ".join(sorted(R.ALLOWED_TYPES))
    return (df.where(norm.isNull())
              .withColumn("reject_reason",
                          F.concat(F.lit("Property type '"), F.col(type_col),
                                   F.lit(f"' is not supported. Supported: {supported}."))))


def add_clean_description(df: DataFrame, description: str = "description",
                          out: str = "description_text") -> DataFrame:
    """Generic description cleaner."""
    return df.withColumn(out, description_text_col(description))

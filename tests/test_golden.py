"""Golden rows for the parsers and rules, derived by hand from the rule semantics."""

import math

from pyspark.sql import functions as F

from propval.functions import fmt
from propval.operators import clean as C
from propval.operators import payment as P
from propval.operators import text as TX


def one(spark, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(cols[n] for n in names)], schema)


def test_location_tier_compound_golden_row(spark):
    # "Al Yasmine, New Cairo": standalone in a premium city
    df = one(spark, location="Al Yasmine, New Cairo", description="Standalone apartment, fully finished.")
    df = C.add_type_and_text(df.withColumn("type", F.lit("Apartment")))
    df = C.add_compound_features(C.add_market_tier(C.add_location(df)))
    r = df.first()
    assert (r.compound, r.city, r.governorate) == ("Al Yasmine", "Al Yasmine", "New Cairo")
    assert r.market_tier == 2.0 and r.is_compound == 0 and r.standalone_premium == 1


def test_location_three_parts_and_missing(spark):
    df = spark.createDataFrame([(" a , b ,c ",), (None,), ("solo",)], "location string")
    got = [(r.compound, r.city, r.governorate) for r in C.add_location(df).collect()]
    assert got == [("a", "b", "c"), ("Unknown", "Unknown", "Unknown"), ("solo", "solo", "solo")]


def test_size_parser_cases(spark):
    cases = {"120 sqm": 120.0, "1,300 sqft": 120.8, "95": 95.0, "3 sqm": None, "9000": None,
             "٣٠٠ sqm": 300.0, ",": None, None: None, "500 sqft": 46.4, "50 sqm 999999 sqft": 50.0}
    df = spark.createDataFrame([(k,) for k in cases], "size string")
    got = {r["size"]: r.size_sqm for r in C.add_size(df).collect()}
    for k, v in cases.items():
        assert got[k] == v, (k, got[k], v)


def test_price_parser(spark):
    df = spark.createDataFrame([("EGP 1,250,000",), ("-5",), ("1.2.3",), ("Ask",), (None,)], "price string")
    got = [r.price_egp for r in C.add_price(df, drop_invalid=False).collect()]
    assert got == [1250000.0, 5.0, None, None, None]


def test_rooms_and_payment(spark):
    df = spark.createDataFrame([("studio", "7+", "Cash", "1.5 million"), ("4 + Maid", "2", "قسط او كاش", "500 k"),
                                ("3", " 2 ", "installments", "5m")],
                               "bedrooms string, bathrooms string, payment_method string, down_payment string")
    df = C.add_payment_flags(C.add_rooms(df))
    df = df.withColumn("dp", C.down_payment_col("down_payment"))
    got = [(r.bedrooms_n, r.bathrooms_n, r.has_maid, r.is_installment, r.is_cash, r.dp) for r in df.collect()]
    assert got == [(None, None, 0, 0, 1, 1.5e6), (4.0, 2.0, 1, 1, 1, 5e5), (3.0, 2.0, 0, 1, 0, 5.0)]


def test_type_normalisation(spark):
    cases = {"Apartment": "Apartment", " villa ": "Villa", "iVilla": "Villa", "Twin House": "Villa",
             "شاليه": "Chalet", "روف": "Penthouse", "Land": None, "Studio": None, "Other": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.n for r in df.select("t", C.normalized_type_col("t").alias("n")).collect()}
    assert got == cases


def test_last_wins_rules(spark):
    df = spark.createDataFrame([("core & shell now super lux finish",), ("semi finished",), ("",)], "desc_clean string")
    got = [r.finish_ord for r in C.add_finish_view(df).collect()]
    assert got == [3.0, 1.0, None]


def test_keyword_type_repair(spark):
    df = spark.createDataFrame([("Apartment", "penthouse and duplex", 100.0), ("Apartment", "big villa", 500.0),
                                ("Apartment", "big villa", 300.0), ("Duplex", "penthouse", 100.0)],
                               "type_clean string, desc_clean string, size_sqm double")
    got = [r.type_clean for r in C.fix_mislabeled_types(df).collect()]
    assert got == ["Duplex", "Villa", "Apartment", "Duplex"]


def test_content_features_examples(spark):
    df = spark.createDataFrame([("Delivery in 2028, 3rd floor, registered contract, brand new!",),
                                ("12 years old building on floor 7",)], "desc_clean string")
    r1, r2 = TX.add_content_features(df).collect()
    assert r1.building_age is None          # future delivery -> negative age -> no fallback
    assert r1.floor_level == 3.0 and r1.legal_status == 1 and r1.condition_score == 4.0
    assert r1.excl_count == 1 and r1.sentence_count == 1
    assert r2.building_age == 12.0 and r2.floor_level == 7.0 and r2.has_explicit_floor == 1


def test_price_format(spark):
    df = spark.createDataFrame([(6_250_000.0,), (10_000_000.0,), (850_400.0,), (999.5,), (12.0,), (1_005_000.0,)],
                               "x double")
    got = [r.t for r in df.select(fmt.price_egp(F.col("x")).alias("t")).collect()]
    assert got == ["6.25M", "10M", "850K", "1,000", "12", "1M"]


def test_payment_tiers(spark):
    df = spark.createDataFrame([(1e6, "Installments", 10.0, 0.1), (1e6, "Cash", 10.0, 0.1),
                                (1e6, "installment", 3.0, None)],
                               "ask double, payment_type string, installment_years double, down_payment_ratio double")
    r = P.adjust_price(df).collect()
    assert r[0].installment_tier == "long" and r[0].method == "pv"
    assert math.isclose(r[0].adjusted_price, 1e6 * min(1 / 1.14 ** 10 + 0.05, 1.0))
    assert r[1].adjusted_price == 1e6 and r[1].method == "cash" and not r[1].is_adjusted
    assert r[2].installment_tier == "short" and math.isclose(r[2].adjusted_price, 1e6 / 1.08)


def test_rental_alias_features(spark):
    df = spark.createDataFrame([("Nice flat, ac, near metro station. wifi",), ("اسانسير و جراجات",)],
                               "description string")
    r1, r2 = TX.add_rental_features(df).collect()
    assert r1.feat_ac == 1 and r1.feat_transport == 1 and r1.feat_wifi == 1 and r1.feat_gym == 0
    assert r1.feature_score == 8 + 10 + 2
    # variants are rewritten before matching: "اسانسير" -> "مصعد", "جراجات" -> "جراج"
    assert r2.feat_elevator == 1 and r2.feat_parking == 1

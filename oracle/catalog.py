"""Oracle SQL per registered query: (sql, double columns to round)."""

from __future__ import annotations

from oracle.clean_sql import CLEAN_COLUMNS_SQL, with_clean

ORACLE: dict[str, tuple[str, list[str]]] = {}


def oracle(name: str, sql: str, doubles=()):
    ORACLE[name] = (sql, list(doubles))


def rounded(sql: str, doubles, digits: int = 6) -> str:
    if not doubles:
        return sql
    repl = ", ".join(f"TRY_CAST(printf('%.{digits}f', {c}) AS DOUBLE) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) _q"


CLEAN_DOUBLES = ["price_egp", "log_price", "size_sqm", "bedrooms_n", "bathrooms_n", "down_payment_ratio",
                 "log_down_payment", "room_ratio", "install_years", "log_comp_size", "finish_ord", "view_score",
                 "market_tier", "area_market_zone_ord", "compound_tier", "log_size_sqm", "size_sqm_inv",
                 "size_per_bedroom", "size_x_finish"]

# ---------------------------------------------------------------- sources
# CSV text: an empty field reads as missing (pandas reads it as NaN as well)
oracle("s1", with_clean("SELECT listing_id, " + ", ".join(
    f"NULLIF({c}, '') AS {c}" for c in ["url", "price", "size", "bedrooms", "bathrooms", "payment_method",
                                        "down_payment", "type", "location", "description"]) + " FROM raw"))

# ---------------------------------------------------------------- per-row cleaning
oracle("c1", with_clean("SELECT listing_id, listing_type FROM s6"))
oracle("c2", with_clean("SELECT listing_id, price_egp FROM s6 WHERE price_egp IS NOT NULL"), ["price_egp"])
oracle("c3", with_clean("SELECT listing_id, size_sqm FROM s6"), ["size_sqm"])
oracle("c4", with_clean("SELECT listing_id, bedrooms_n, bathrooms_n, has_maid FROM s6"),
       ["bedrooms_n", "bathrooms_n"])
oracle("c7", with_clean("SELECT listing_id, is_installment, is_cash FROM s6"))
oracle("c8", with_clean("SELECT listing_id, dp_value AS down_payment_egp FROM s6"), ["down_payment_egp"])
oracle("c9", with_clean("SELECT listing_id, down_payment_ratio, log_down_payment FROM s6 "
                        "WHERE price_egp IS NOT NULL"), ["down_payment_ratio", "log_down_payment"])
oracle("c10", with_clean("SELECT listing_id, type_raw AS type_clean, desc_clean FROM s6"))
oracle("c12", with_clean("SELECT listing_id, room_ratio FROM s6"), ["room_ratio"])
oracle("c13", with_clean("SELECT listing_id, compound, city, governorate FROM s6"))
oracle("c14", with_clean("SELECT listing_id, install_years FROM s6"), ["install_years"])
oracle("c15", with_clean("SELECT listing_id, finish_ord, view_score FROM s6"), ["finish_ord", "view_score"])
oracle("c17", with_clean("SELECT listing_id, market_tier FROM s6"), ["market_tier"])
oracle("c18", with_clean("SELECT listing_id, area_market_zone, area_market_zone_ord FROM s6"),
       ["area_market_zone_ord"])
oracle("c19", with_clean("SELECT listing_id, is_compound, compound_tier, standalone_premium, compound_premium "
                         "FROM s6"), ["compound_tier"])
oracle("c22", with_clean("SELECT listing_id, log_size_sqm, size_sqm_inv, size_per_bedroom, size_x_finish, "
                         "size_bucket FROM s6"),
       ["log_size_sqm", "size_sqm_inv", "size_per_bedroom", "size_x_finish"])
oracle("c24", with_clean("SELECT listing_id, type_kw AS type_clean FROM s6"))
oracle("c29", """
SELECT listing_id,
       trim(regexp_replace(regexp_replace(
            regexp_replace(coalesce(description, ''), 'http\\S+|www\\S+|https\\S+', '', 'g'),
            '[^\\p{L}\\p{N}_\\s\\x{0600}-\\x{06FF}]', ' ', 'g'), '\\s+', ' ', 'g')) AS description_text
FROM (""" + with_clean("SELECT * FROM raw") + ") r")
oracle("c30", with_clean(f"SELECT {CLEAN_COLUMNS_SQL} FROM clean"), CLEAN_DOUBLES)

# ---------------------------------------------------------------- set-based cleaning
oracle("g1", with_clean("SELECT listing_id, price_egp, log_price FROM trimmed"), ["price_egp", "log_price"])
oracle("g2", with_clean("SELECT listing_id, compound, log_comp_size FROM trimmed"), ["log_comp_size"])
oracle("g3", with_clean("""
SELECT city, fence_bin, quantile_cont(ppsm, 0.25) AS q25, quantile_cont(ppsm, 0.75) AS q75, count(ppsm) AS n,
       quantile_cont(ppsm, 0.75) - quantile_cont(ppsm, 0.25) AS iqr,
       quantile_cont(ppsm, 0.75) + 3.0 * (quantile_cont(ppsm, 0.75) - quantile_cont(ppsm, 0.25)) AS upper_fence
FROM apts WHERE fence_bin IS NOT NULL AND ppsm IS NOT NULL
GROUP BY city, fence_bin
HAVING count(ppsm) >= 10 AND (SELECT count(*) FROM apts) >= 100"""), ["q25", "q75", "iqr", "upper_fence"])
oracle("g4", with_clean("SELECT listing_id, type_fixed AS type_clean, CAST(suspicious AS INTEGER) AS "
                        "fence_relabelled FROM s8"))
oracle("c30_by_city_type", with_clean(f"""
SELECT city, type_clean, count(*) AS n_listings, round(avg(price_egp), 2) AS avg_price,
       quantile_cont(ppsm, 0.5) AS median_ppsm
FROM (SELECT {CLEAN_COLUMNS_SQL}, ppsm FROM clean) c
GROUP BY city, type_clean"""), ["avg_price", "median_ppsm"])

from oracle.clean_sql import TYPE_CASE  # noqa: E402

_NORMAL = TYPE_CASE.format(c="type_fixed")
oracle("j1_quality", with_clean(f"""
SELECT (SELECT count(*) FROM s6) AS rows_in, (SELECT count(*) FROM s6 WHERE price_egp IS NULL) AS price_unparsed,
       count(*) AS rows_trimmed, count(*) FILTER (WHERE size_sqm IS NULL) AS size_unparsed,
       count(*) FILTER (WHERE bedrooms_n IS NULL) AS bedrooms_unparsed,
       count(*) FILTER (WHERE bathrooms_n IS NULL) AS bathrooms_unparsed,
       count(*) FILTER (WHERE ({_NORMAL}) IS NULL) AS types_dropped,
       CAST(sum(CAST(suspicious AS INTEGER)) AS BIGINT) AS fence_relabelled
FROM s8"""))

_ASK_TYPE = TYPE_CASE.format(c="type_kw")
oracle("j1_asks", with_clean(f"""
SELECT v.listing_id, {_ASK_TYPE} AS type_clean, v.compound, v.price_egp, n.log_comp_size, v.size_sqm
FROM valid v LEFT JOIN (SELECT compound, ln(1 + count(*)) AS log_comp_size FROM trimmed
                        WHERE compound IS NOT NULL GROUP BY compound) n ON v.compound = n.compound
WHERE {_ASK_TYPE} IS NOT NULL"""), ["price_egp", "log_comp_size", "size_sqm"])

oracle("j6_by_type", with_clean(f"""
SELECT {_ASK_TYPE} AS type_clean, count(*) AS n_asks, count(*) AS n_ordered, count(*) AS n_decided
FROM valid WHERE {_ASK_TYPE} IS NOT NULL GROUP BY 1"""))

oracle("c25", with_clean(f"SELECT listing_id, {TYPE_CASE.format(c='type_raw')} AS type_normalized FROM s6"))
oracle("c26", with_clean(f"SELECT listing_id, {TYPE_CASE.format(c='type_raw')} AS type_clean FROM s6 "
                         f"WHERE {TYPE_CASE.format(c='type_raw')} IS NOT NULL"))
oracle("c27", with_clean(f"""
SELECT listing_id, type_fixed AS type_clean,
       'Property type ''' || type_fixed || ''' is not supported. Supported: Apartment, Chalet, Duplex, Penthouse, Villa.'
         AS reject_reason
FROM s8 WHERE {TYPE_CASE.format(c='type_fixed')} IS NULL"""))
oracle("c28", with_clean(f"""
SELECT listing_id, city_comp, governorate_comp,
       compound || '_' || type_clean AS comp_type,
       CAST(CAST(coalesce(bedrooms_n, 0) AS BIGINT) AS VARCHAR) || '_' || type_clean AS bed_type,
       CAST(CAST(regexp_matches(lower(desc_clean), 'north\\s*coast|ras\\s*el?\\s*hekma|sahel') AS INTEGER) AS VARCHAR)
         || '_' || type_clean AS nc_type,
       CAST(CAST(coalesce(finish_ord, -1) AS BIGINT) AS VARCHAR) || '_' || type_clean AS finish_type,
       type_clean || '_' || CAST(CAST(market_tier AS BIGINT) AS VARCHAR) AS type_tier
FROM (SELECT {CLEAN_COLUMNS_SQL} FROM clean) c"""))

# ---------------------------------------------------------------- description features
from oracle import text_sql as TS  # noqa: E402
from propval.functions import rules as R  # noqa: E402

oracle("t1", with_clean(f"SELECT listing_id, {TS.kw_select()} FROM s6"), ["desc_len", "nlp_score"])
oracle("t3", with_clean(f"SELECT listing_id, {TS.semantic_select()} FROM s6"),
       ["luxury_score", "budget_score", "investment_signal"])
_CONTENT = f"SELECT listing_id, {TS.content_select()} FROM s6"
for _name, _cols in {
    "t4": ["building_age", "under_construction"], "t5": ["floor_level", "has_explicit_floor"],
    "t6": ["legal_status"], "t7": ["condition_score"], "t8": [n for n, _ in R.AMENITY_FLAGS],
    "t9": [n for n, _ in R.MICRO_LOCATION_FLAGS],
    "t10": [n for n, _ in R.MOTIVATION_FLAGS] + ["motivation_score"],
    "t11": [n for n, _ in R.EXPOSURE_FLAGS], "t12": [n for n, _ in R.ROOM_CONFIG_FLAGS],
    "t14": [],
}.items():
    oracle(_name, with_clean(f"SELECT {', '.join(['listing_id', *_cols]) if _cols else '*'} FROM ({_CONTENT}) c"),
           [c for c in TS.CONTENT_DOUBLES if not _cols or c in _cols])
_TEXT = "coalesce(text, '')"
oracle("t13", f"SELECT doc_id, {TS.meta_select(_TEXT)} FROM documents", ["caps_ratio"])
oracle("t13_conversations", f"SELECT conv_id, turn, {TS.meta_select(_TEXT)} FROM conversations", ["caps_ratio"])


def _norm_sql(expr):
    s = f"lower(coalesce({expr}, ''))"
    for variant, canonical in R.ARABIC_VARIANTS:
        s = f"replace({s}, '{variant.lower()}', '{canonical.lower()}')"
    return s


def _feature_sql(norm):
    flags, srcs = [], []
    for feat, aliases in R.FEATURE_ALIASES.items():
        told = TS.any_alias(norm, aliases)
        flags.append(f"CAST({told} AS INTEGER) AS feat_{feat}")
        srcs.append(f"CASE WHEN {told} THEN 'nlp' ELSE 'none' END AS src_{feat}")
    return flags, srcs


def _checkbox_sql(norm):
    flags, srcs = [], []
    for i, (feat, aliases) in enumerate(R.FEATURE_ALIASES.items()):
        told, turn = TS.any_alias(norm, aliases), f"(listing_id + {i}) % 4"
        flags.append(f"CASE {turn} WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE CAST({told} AS INTEGER) END AS feat_{feat}")
        srcs.append(f"CASE WHEN {turn} <> 0 THEN 'checkbox' WHEN {told} THEN 'nlp' ELSE 'none' END AS src_{feat}")
    return flags, srcs


_flags, _srcs = _feature_sql("norm")
_RENTAL_FEATS = with_clean(f"SELECT listing_id, {', '.join(_flags + _srcs)} FROM "
                           f"(SELECT listing_id, {_norm_sql('description')} AS norm FROM raw) r")
_SCORE = " + ".join(f"feat_{f} * {R.FEATURE_WEIGHTS.get(f, 0)}" for f in R.FEATURE_ALIASES)
_ACTIVE = "concat_ws(',', " + ", ".join(f"CASE WHEN feat_{f} = 1 THEN '{f}' END" for f in R.FEATURE_ALIASES) + ")"
oracle("t15", with_clean(f"SELECT listing_id, {_norm_sql('description')} AS desc_norm FROM raw"))
oracle("t16", f"SELECT listing_id, {', '.join('feat_' + f for f in R.FEATURE_ALIASES)} FROM ({_RENTAL_FEATS}) f")
_boxed = [x for part in _checkbox_sql("norm") for x in part]
_BOXED_FEATS = with_clean(f"SELECT listing_id, {', '.join(_boxed)} FROM "
                          f"(SELECT listing_id, {_norm_sql('description')} AS norm FROM raw) r")
oracle("t16_checkbox", f"SELECT *, CAST({_SCORE} AS INTEGER) AS feature_score FROM ({_BOXED_FEATS}) f")
oracle("t17", f"SELECT listing_id, {', '.join('src_' + f for f in R.FEATURE_ALIASES)} FROM ({_RENTAL_FEATS}) f")
oracle("t18", f"SELECT listing_id, CAST({_SCORE} AS INTEGER) AS feature_score, {_ACTIVE} AS active_features "
              f"FROM ({_RENTAL_FEATS}) f")
oracle("t18_by_score", f"SELECT CAST({_SCORE} AS INTEGER) AS feature_score, count(*) AS n_listings "
                       f"FROM ({_RENTAL_FEATS}) f GROUP BY 1")

# ---------------------------------------------------------------- encodings
from oracle import decide_sql as DS  # noqa: E402

_TE = [c for c, _ in R.TE_SMOOTHING]
oracle("g5", DS.with_enc("SELECT listing_id, is_test FROM enc_base"))
oracle("g6", DS.with_enc("SELECT listing_id, fold FROM enc_base"))
oracle("m2_by_fold", DS.with_enc("SELECT fold, count(*) AS n_rows, count(*) AS n_finite FROM train GROUP BY fold"))
oracle("m8_by_fold", DS.with_enc("SELECT is_test, fold, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing FROM enc_base GROUP BY ALL"))
oracle("m7_by_type", DS.with_enc("SELECT type_clean, count(*) AS n_rows, count(*) AS n_listings, count(*) AS n_priced FROM test GROUP BY type_clean"))
oracle("t20_factors", "SELECT CAST(i AS INTEGER) AS factor, true AS orthogonal, true AS ordered FROM range(25) t(i)")
_oof_joins = " ".join(f"JOIN ({DS.te_oof_sql(c, k)}) t_{c} USING (listing_id)" for c, k in R.TE_SMOOTHING)
oracle("g8", DS.with_enc(f"SELECT listing_id, {', '.join(c + '_te' for c in _TE)} FROM train {_oof_joins}"),
       [c + "_te" for c in _TE])
oracle("g7", DS.with_enc(DS.te_oof_sql("compound", 30)), ["compound_te"])
# the wanted model columns that the encoded training rows have, in their order: numeric ones, then the encodings
_G13_NUMERIC = """size_sqm bedrooms_n bathrooms_n has_maid is_installment is_cash room_ratio install_years log_comp_size finish_ord view_score
    down_payment_ratio log_down_payment market_tier size_per_bedroom size_x_finish price_per_sqm_estimate area_market_zone_ord is_compound
    compound_tier standalone_premium compound_premium log_size_sqm size_sqm_inv""".split()
_G13 = [*_G13_NUMERIC, *(c + "_te" for c in _TE)]
_G13_TABLE = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, count(*) AS n_rows, "
    + ("count(*)" if c.endswith("_te") else f"(SELECT count({c}) FROM ({DS.PPS_OOF_SQL}))" if c == "price_per_sqm_estimate"
       else f"count({c})") + " AS n_present, CAST(0 AS BIGINT) AS n_nan FROM train"
    for i, c in enumerate(_G13))
oracle("g13", DS.with_enc(_G13_TABLE))
oracle("g9", DS.with_enc(DS.PPS_OOF_SQL), ["price_per_sqm_estimate"])
_full_joins = " ".join(f"JOIN ({DS.te_full_sql(c, k)}) t_{c} USING (listing_id)" for c, k in R.TE_SMOOTHING)
oracle("g10", DS.with_enc(f"SELECT listing_id, {', '.join(c + '_te' for c in _TE)}, price_per_sqm_estimate "
                          f"FROM test {_full_joins} JOIN ({DS.PPS_TEST_SQL}) p USING (listing_id)"),
       [c + "_te" for c in _TE] + ["price_per_sqm_estimate"])
oracle("g11", DS.with_enc("SELECT city, type_clean, rarity FROM rarity"), ["rarity"])

_G12 = ["size_sqm", "bedrooms_n", "bathrooms_n", "room_ratio", "install_years", "down_payment_ratio",
        "log_down_payment", "size_per_bedroom", "finish_ord", "log_comp_size"]
_g12_long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM train" for c in _G12)
_G12_TABLE = f"""
long AS ({_g12_long}),
med AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM long GROUP BY feature),
imp AS (SELECT l.feature, coalesce(l.value, m.median) AS value FROM long l JOIN med m USING (feature)),
g12 AS (SELECT m.feature, m.median, quantile_cont(i.value, 0.01) AS clip_lo, quantile_cont(i.value, 0.99) AS clip_hi
        FROM med m JOIN imp i USING (feature) GROUP BY m.feature, m.median)"""
oracle("g12", f"WITH {DS.CLEAN_CTES}, {DS.ENC_CTES}, {_G12_TABLE} SELECT feature, median, clip_lo, clip_hi FROM g12",
       ["median", "clip_lo", "clip_hi"])


def _clip_expr(c):
    v = (f"coalesce(CAST(t.{c} AS DOUBLE), (SELECT median FROM g12 WHERE feature = '{c}'))")
    return (f"least(greatest({v}, (SELECT clip_lo FROM g12 WHERE feature = '{c}')), "
            f"(SELECT clip_hi FROM g12 WHERE feature = '{c}')) AS {c}")


oracle("g12_apply", f"WITH {DS.CLEAN_CTES}, {DS.ENC_CTES}, {_G12_TABLE} SELECT listing_id, "
                    + ", ".join(_clip_expr(c) for c in _G12) + " FROM test t", _G12)

# ---------------------------------------------------------------- decisions
_DEC = {
    "d1": ["pred_b", "lo_b", "hi_b"],
    "d2": ["discount", "pred_c", "lo_c", "hi_c"],
    "d3": ["zone", "pred_f", "lo_f", "hi_f"],
    "d4": ["uncertainty", "band_lower", "band_upper"],
    "d5": ["ratio", "alert_raw"],
    "d6": ["conf_score_raw", "CASE WHEN conf_score_raw >= 75 THEN 'HIGH' WHEN conf_score_raw >= 50 THEN 'MEDIUM' "
           "ELSE 'LOW' END AS conf_level_raw"],
    "d7": ["rarity_score", "rarity_penalty", "is_rare"],
    "d8": ["benchmark_deviation", "is_unrealistic"],
    "d9": ["alert", "confidence", "confidence_score"],
    "d11": ["reason"],
    "d12": ["down_payment_warning"],
    "d14": ["alert", "confidence", "confidence_score", "reason", "ratio", "zone", "down_payment_warning"],
}
_DEC_DOUBLES = {"pred_b", "lo_b", "hi_b", "discount", "pred_c", "lo_c", "hi_c", "pred_f", "lo_f", "hi_f",
                "uncertainty", "band_lower", "band_upper", "ratio", "rarity_score", "benchmark_deviation"}
for _name, _cols in _DEC.items():
    oracle(_name, DS.with_decide(f"SELECT listing_id, {', '.join(_cols)} FROM d14"),
           [c for c in _cols if c in _DEC_DOUBLES])
oracle("d10", "SELECT listing_id, " + ", ".join(
    f"{DS.price_text(c)} AS {c}_text" for c in ("ask", "pred", "lo", "hi")) + f" FROM ({DS.SCORED_SQL}) s")
oracle("d14_by_city_type", DS.with_decide("SELECT area, type_clean, alert, confidence, count(*) AS n, "
                                          "avg(confidence_score) AS avg_score FROM d14 GROUP BY ALL"), ["avg_score"])

# ---------------------------------------------------------------- rental
def _contains_any_sql(expr, words):
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


_Y = R.RENTAL_YIELDS


def _yield_case(i):
    exact = " ".join(f"WHEN rent_zone = '{z}' AND type_clean = '{t}' THEN {y[i]}" for (z, t), y in _Y.items())
    fb = " ".join(f"WHEN rent_zone = '{z}' THEN {y[i]}" for (z, t), y in _Y.items() if t == "Apartment")
    return f"CAST(CASE {exact} {fb} ELSE {R.DEFAULT_YIELD[i]} END AS DOUBLE)"


_EXACT = " OR ".join(f"(rent_zone = '{z}' AND type_clean = '{t}')" for (z, t) in _Y)
_FB = " OR ".join(f"rent_zone = '{z}'" for (z, t) in _Y if t == "Apartment")
_src_score = " + ".join(f"CASE WHEN src_{f} = 'nlp' THEN 2 ELSE 0 END" for f in R.FEATURE_ALIASES)
_blob = "lower(coalesce(area, '') || ' ' || coalesce(compound, '') || ' ' || coalesce(\"desc\", ''))"
_zone = ("CASE " + " ".join(f"WHEN {_contains_any_sql(_blob, ws)} THEN '{z}'" for z, ws in R.RENT_ZONE_WORDS)
         + " ELSE 'urban' END")
_mape = DS.case_map("type_clean", R.MAPE_BY_TYPE, "0.2")
_premium = ("CASE WHEN feature_score <= 10 THEN 0.0 WHEN feature_score <= 20 THEN 0.05 WHEN feature_score <= 35 "
            "THEN 0.12 WHEN feature_score <= 50 THEN 0.20 ELSE 0.30 END")
_ftier = ("CASE WHEN feature_score <= 10 THEN 'base' WHEN feature_score <= 20 THEN 'standard' "
          "WHEN feature_score <= 35 THEN 'enhanced' WHEN feature_score <= 50 THEN 'premium' ELSE 'luxury' END")
_good = _contains_any_sql("lower(area)", R.RENT_GOOD_AREAS)


def _rent_ar(t, lo="lo_t", hi="hi_t", zone="zlabel"):
    a, rest = t.split("{lo}")
    b, rest = rest.split("{hi}")
    c, d = rest.split("{zone}")
    return f"'{a}' || {lo} || '{b}' || {hi} || '{c}' || {zone} || '{d}'"


RENTAL_CTES = f"""
rf AS ({_RENTAL_FEATS}),
rent_in AS (
  SELECT s.listing_id, s.pred AS sale_price, s.ask / 200 AS user_rent, s.type_clean, s.city AS area,
         r.compound, r.description AS "desc", rf.*, CAST({_SCORE} AS INTEGER) AS feature_score
  FROM ({DS.SCORED_SQL}) s LEFT JOIN s6 r ON s.listing_id = r.listing_id LEFT JOIN rf ON rf.listing_id = s.listing_id
),
r1 AS (SELECT rent_in.* EXCLUDE (listing_id), s_id AS listing_id, {_zone} AS rent_zone
       FROM (SELECT *, listing_id AS s_id FROM rent_in) rent_in),
r2 AS (
  SELECT *, {_yield_case(0)} AS yield_min, {_yield_case(1)} AS yield_max, {_yield_case(2)} AS yield_typical,
    CASE WHEN {_EXACT} THEN 'HIGH' WHEN {_FB} THEN 'MEDIUM' ELSE 'LOW' END AS estimate_confidence,
    {_mape} AS sale_mape,
    CAST(least({_premium}, 0.45) AS DOUBLE) AS premium_pct, {_ftier} AS feature_tier
  FROM r1
),
r3 AS (
  SELECT r2.*,
    sale_price * yield_min / 12.0 / (1.0 + sale_mape) AS min_rent,
    sale_price * yield_typical / 12.0 AS mid_rent,
    sale_price * yield_max / 12.0 * (1.0 + sale_mape) AS max_rent,
    least(greatest(least(50 + {_src_score}, 80)
      + CASE WHEN lower(area) IN ('unknown', '', 'na', 'n/a') THEN -15 WHEN {_good} THEN 10 ELSE 5 END
      + CASE WHEN length(trim(coalesce("desc", ''))) < 20 THEN -10
             WHEN length(trim(coalesce("desc", ''))) > 100 THEN 5 ELSE 0 END
      + CASE WHEN coalesce(ra.rarity, 0) > 0.5 THEN -15 WHEN coalesce(ra.rarity, 0) > 0.3 THEN -8 ELSE 0 END,
      20), 95) AS rent_conf_score
  FROM r2 LEFT JOIN rarity ra ON r2.area = ra.city AND r2.type_clean = ra.type_clean
),
r4 AS (
  SELECT *, min_rent * (1 + premium_pct) AS adj_min, mid_rent * (1 + premium_pct) AS adj_mid,
    max_rent * (1 + premium_pct) AS adj_max,
    CASE WHEN rent_conf_score >= 75 THEN 'HIGH' WHEN rent_conf_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END
      AS rent_conf_level
  FROM r3
),
r5 AS (
  SELECT *,
    CASE WHEN estimate_confidence = 'LOW' OR rent_conf_level = 'LOW' THEN 'LOW'
         WHEN estimate_confidence = 'MEDIUM' OR rent_conf_level = 'MEDIUM' THEN 'MEDIUM' ELSE 'HIGH' END
      AS rental_confidence,
    CASE WHEN adj_mid > 0 THEN user_rent / adj_mid ELSE 1.0 END AS rent_ratio
  FROM r4
),
r6 AS (
  SELECT *,
    CAST(CASE rental_confidence WHEN 'LOW' THEN 0.70 WHEN 'HIGH' THEN 0.85 ELSE 0.80 END AS DOUBLE) AS threshold_lower,
    CAST(CASE rental_confidence WHEN 'LOW' THEN 1.35 WHEN 'HIGH' THEN 1.20 ELSE 1.25 END AS DOUBLE) AS threshold_upper
  FROM r5
),
r7 AS (
  SELECT *,
    CASE WHEN rent_ratio < 0.5 THEN 'UNDERPRICED' WHEN rent_ratio > 2.0 THEN 'OVERPRICED'
         WHEN rent_ratio < threshold_lower THEN 'UNDERPRICED' WHEN rent_ratio > threshold_upper THEN 'OVERPRICED'
         ELSE 'FAIR' END AS rent_alert,
    CASE WHEN rent_ratio < 0.5 OR rent_ratio > 2.0 THEN 'LOW' ELSE rental_confidence END AS decision_confidence,
    {DS.price_text('adj_min')} AS lo_t, {DS.price_text('adj_max')} AS hi_t,
    CASE rent_zone {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.RENT_ZONE_LABELS.items())}
      ELSE '{R.RENT_ZONE_LABELS['urban']}' END AS zlabel
  FROM r6
),
r8 AS (
  SELECT *,
    CASE WHEN rent_alert = 'UNDERPRICED' THEN {_rent_ar(R.RENT_AR_UNDER)}
         WHEN rent_alert = 'OVERPRICED' THEN {_rent_ar(R.RENT_AR_OVER)} ELSE {_rent_ar(R.RENT_AR_FAIR)} END
    || chr(10) ||
    CASE WHEN rental_confidence = 'LOW' THEN '{R.RENT_AR_LOW}' WHEN feature_score >= 30 THEN '{R.RENT_AR_MANY}'
         WHEN feature_score >= 15 THEN '{R.RENT_AR_SOME}' ELSE '{R.RENT_AR_BASIC}' END AS rental_reason
  FROM r7
)
"""


def with_rental(select_sql):
    return f"WITH {DS.CLEAN_CTES}, {DS.ENC_CTES}, {RENTAL_CTES}\n{select_sql}"


_RENT = {
    "r1": ["rent_zone"],
    "r2": ["yield_min", "yield_typical", "yield_max", "estimate_confidence", "min_rent", "mid_rent", "max_rent"],
    "r3": ["premium_pct", "feature_tier"],
    "r4": ["rent_conf_score", "rent_conf_level"],
    "r5": ["rent_ratio", "threshold_lower", "threshold_upper", "rent_alert", "decision_confidence"],
    "r6": ["rental_reason"],
    "r7": ["rent_alert", "rental_reason", "rental_confidence", "rent_conf_score", "rent_ratio", "adj_min", "adj_mid",
           "adj_max", "rent_zone", "premium_pct", "feature_score", "feature_tier", "threshold_lower",
           "threshold_upper"],
    "g15": ["rent_zone", "type_clean", "yield_min", "yield_typical", "yield_max", "estimate_confidence"],
}
_RENT_DOUBLES = {"yield_min", "yield_typical", "yield_max", "min_rent", "mid_rent", "max_rent", "premium_pct",
                 "rent_ratio", "threshold_lower", "threshold_upper", "adj_min", "adj_mid", "adj_max"}
for _name, _cols in _RENT.items():
    oracle(_name, with_rental(f"SELECT listing_id, {', '.join(_cols)} FROM r8"),
           [c for c in _cols if c in _RENT_DOUBLES])
oracle("r7_by_zone", with_rental("SELECT rent_zone, rent_alert, rental_confidence, count(*) AS n, "
                                 "avg(adj_mid) AS avg_expected_rent FROM r8 GROUP BY ALL"), ["avg_expected_rent"])

# ---------------------------------------------------------------- payment
_ITIER = ("CASE WHEN {y} IS NULL OR isnan({y}) OR {y} <= 0 THEN 'cash' WHEN {y} <= 4 THEN 'short' "
          "WHEN {y} <= 7 THEN 'medium' WHEN {y} <= 12 THEN 'long' ELSE 'very_long' END")
_DTIER = ("CASE WHEN {r} IS NULL OR isnan({r}) OR {r} <= 0 THEN 'medium' WHEN {r} >= 0.30 THEN 'high' "
          "WHEN {r} >= 0.15 THEN 'medium' WHEN {r} >= 0.05 THEN 'low' ELSE 'very_low' END")
PAY_CTES = f"""
pay0 AS (
  SELECT *, {_ITIER.format(y='installment_years')} AS itier, {_DTIER.format(r='down_payment_ratio')} AS dtier,
    {_contains_any_sql("lower(trim(coalesce(payment_type, 'None')))", R.PAYMENT_INSTALLMENT_WORDS)} AS is_inst
  FROM ({DS.SCORED_SQL}) s
),
pay1 AS (
  SELECT *, CAST(CASE dtier WHEN 'high' THEN 0.0 WHEN 'medium' THEN 0.03 WHEN 'low' THEN 0.05 WHEN 'very_low' THEN 0.08
                 END AS DOUBLE) AS dp_add,
    itier IN ('long', 'very_long') AND installment_years > 0 AS long_plan
  FROM pay0
),
pay2 AS (
  SELECT *,
    CASE WHEN NOT is_inst THEN ask WHEN itier = 'cash' THEN ask
         WHEN long_plan THEN ask * least(1.0 / pow(1.14, installment_years) + dp_add, 1.0)
         ELSE ask / least(CAST(CASE itier WHEN 'short' THEN 1.05 WHEN 'medium' THEN 1.10 ELSE 1.10 END AS DOUBLE)
                          + dp_add, 1.35) END AS adjusted_price,
    CASE WHEN is_inst AND long_plan THEN 0.14 ELSE 0.0 END AS discount_rate
  FROM pay1
),
pay3 AS (
  SELECT *,
    CASE WHEN NOT is_inst THEN 1.0 WHEN adjusted_price > 0 THEN ask / adjusted_price ELSE 1.0 END AS multiplier,
    CASE WHEN is_inst THEN itier ELSE 'cash' END AS installment_tier,
    CASE WHEN is_inst THEN dtier ELSE 'high' END AS down_payment_tier,
    CASE WHEN NOT is_inst THEN 'cash' WHEN discount_rate > 0 THEN 'pv' ELSE 'linear' END AS method
  FROM pay2
),
pay4 AS (
  SELECT *, is_inst AND multiplier > 1.01 AS is_adjusted FROM pay3
),
pay5 AS (
  SELECT *,
    CASE WHEN NOT is_adjusted THEN '' WHEN method = 'pv' THEN '{R.PAY_AR_PV}'
         WHEN installment_tier = 'short' THEN '{R.PAY_AR_SHORT}'
         WHEN installment_tier IN ('long', 'very_long') THEN '{R.PAY_AR_LONG}' ELSE '{R.PAY_AR_OTHER}' END
      AS payment_explanation
  FROM pay4
)
"""
oracle("p1", f"WITH {PAY_CTES} SELECT listing_id, itier AS installment_class, dtier AS down_payment_class FROM pay5")
oracle("p2", f"WITH {PAY_CTES} SELECT listing_id, adjusted_price, multiplier, CAST(discount_rate AS DOUBLE) AS "
             "discount_rate, method FROM pay5", ["adjusted_price", "multiplier", "discount_rate"])
oracle("p3", f"WITH {PAY_CTES} SELECT listing_id, adjusted_price, multiplier, installment_tier, down_payment_tier, "
             "is_adjusted, CAST(discount_rate AS DOUBLE) AS discount_rate, method, payment_explanation FROM pay5",
       ["adjusted_price", "multiplier", "discount_rate"])
oracle("p3_by_tier", f"WITH {PAY_CTES} SELECT installment_tier, down_payment_tier, count(*) AS n, "
                     "avg(multiplier) AS avg_multiplier, round(sum(adjusted_price), 2) AS sum_adjusted FROM pay5 GROUP BY ALL",
       ["avg_multiplier", "sum_adjusted"])

# ---------------------------------------------------------------- evaluation / monitoring
_EVAL = f"""ev AS (
  SELECT c.*, c.price_egp AS true_price, s.pred AS pred_price, c.log_price AS y_log, ln(1 + s.pred) AS pred_log
  FROM (SELECT {CLEAN_COLUMNS_SQL} FROM clean) c JOIN ({DS.SCORED_SQL}) s USING (listing_id))"""
_R2 = ("1.0 - sum((y_log - pred_log) * (y_log - pred_log)) / (var_pop(y_log) * count(y_log)) AS r2, "
       "avg(abs(true_price - pred_price) / true_price) * 100 AS mape_pct")
def with_eval(select_sql):
    return f"WITH {DS.CLEAN_CTES}, {_EVAL}\n{select_sql}"


oracle("v1", with_eval(f"SELECT count(*) AS n, {_R2} FROM ev"), ["r2", "mape_pct"])
oracle("v1_by_type", with_eval(f"SELECT type_clean, count(*) AS n, {_R2} FROM ev GROUP BY type_clean"),
       ["r2", "mape_pct"])
oracle("v2", with_eval("SELECT type_clean, count(*) AS n, avg(abs(true_price - pred_price) / true_price) * 100 "
                        "AS mape_pct FROM ev WHERE type_clean IN ('Apartment', 'Villa', 'Penthouse', 'Duplex', "
                        "'Chalet') GROUP BY type_clean HAVING count(*) >= 10").replace(
    "\nSELECT", f", {_EVAL}\nSELECT", 1), ["mape_pct"])
oracle("v3", with_eval("SELECT is_compound, count(*) AS n, avg(abs(true_price - pred_price) / true_price) * 100 "
                        "AS mape_pct, avg((pred_price - true_price) / true_price) * 100 AS bias_pct, "
                        "abs(avg((pred_price - true_price) / true_price) * 100) > 20 AS severe_bias "
                        "FROM ev WHERE market_tier >= 2 GROUP BY is_compound HAVING count(*) >= 5"), ["mape_pct", "bias_pct"])
oracle("v4", with_clean("SELECT count(*) FILTER (WHERE market_tier >= 2) AS premium_total, "
                        "count(*) FILTER (WHERE market_tier >= 2 AND is_compound = 1) AS premium_compound, "
                        "count(*) FILTER (WHERE market_tier >= 2 AND is_compound = 0) AS premium_standalone "
                        "FROM clean"))
_V6 = ["size_sqm", "bedrooms_n", "bathrooms_n", "finish_ord", "install_years", "down_payment_ratio",
       "building_age", "floor_level", "condition_score", "room_ratio"]
_CONTENT_CLEAN = f"SELECT c.*, {TS.content_select()} FROM (SELECT {CLEAN_COLUMNS_SQL} FROM clean) c"
oracle("v6", with_clean(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) / count(*) AS missing_share "
    f"FROM ({_CONTENT_CLEAN}) x" for c in _V6)), ["missing_share"])
oracle("v6_lineage", with_clean(" UNION ALL ".join(
    f"SELECT listing_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {c} IS NULL AS is_missing "
    f"FROM ({_CONTENT_CLEAN}) x WHERE standalone_premium = 1" for c in _V6)), ["value"])

_FB = ("fb AS (SELECT listing_id, ask AS price, pred AS predicted, type_clean AS type, alert, confidence, "
       "CASE WHEN ask >= lo AND ask <= hi THEN 'up' ELSE 'down' END AS feedback FROM d14)")
def with_fb(select_sql):
    return f"WITH {DS.CLEAN_CTES}, {DS.ENC_CTES}, {DS.DECIDE_CTES}, {_FB}\n{select_sql}"


oracle("s4", with_fb("SELECT TIMESTAMP '2024-01-01' + to_minutes(listing_id) AS timestamp, listing_id, price, predicted, alert, "
                      "confidence, feedback, type FROM fb"),
       ["price", "predicted"])
oracle("q2", with_fb("SELECT type, alert, confidence, count(*) AS n, avg(CAST(feedback = 'up' AS DOUBLE)) "
                            "AS up_share, avg(CAST(feedback = 'down' AS DOUBLE)) AS down_share, "
                            "avg(abs(price - predicted) / price) AS mean_ape FROM fb GROUP BY ALL"),
       ["up_share", "down_share", "mean_ape"])


def _psi_sql(base_sql, cur_sql):
    qs = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
    return f"""
pb AS ({base_sql}), pc AS ({cur_sql}),
edges AS (SELECT feature, [{qs}] AS edges FROM pb GROUP BY feature),
bb AS (SELECT b.feature, len(list_filter(e.edges, lambda x: x < b.value)) AS bin FROM pb b JOIN edges e USING (feature)),
cb AS (SELECT c.feature, len(list_filter(e.edges, lambda x: x < c.value)) AS bin FROM pc c JOIN edges e USING (feature)),
es AS (SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS e FROM bb GROUP BY feature, bin),
cs AS (SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS a FROM cb GROUP BY feature, bin),
grid AS (SELECT feature, unnest(range(10)) AS bin FROM edges),
psi AS (
  SELECT g.feature, sum((greatest(coalesce(a, 0), 1e-4) - greatest(coalesce(e, 0), 1e-4))
                        * ln(greatest(coalesce(a, 0), 1e-4) / greatest(coalesce(e, 0), 1e-4))) AS psi
  FROM grid g LEFT JOIN es USING (feature, bin) LEFT JOIN cs USING (feature, bin) GROUP BY g.feature)
SELECT feature, psi, CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'monitor' ELSE 'retrain' END AS status
FROM psi"""


_PSI_F = ["price_egp", "size_sqm", "log_comp_size", "bedrooms_n", "view_score"]


def _long_sql(src):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src} "
                              f"WHERE {c} IS NOT NULL" for c in _PSI_F)


oracle("q3", f"WITH {DS.CLEAN_CTES}, {DS.ENC_CTES}, " + _psi_sql(_long_sql("train"), _long_sql("test")), ["psi"])
_EV_MID = "(SELECT min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) / 2 FROM events)"
oracle("q3_events", "WITH " + _psi_sql(
    f"SELECT 'value' AS feature, value FROM events WHERE value IS NOT NULL AND epoch(ts) < {_EV_MID}",
    f"SELECT 'value' AS feature, value FROM events WHERE value IS NOT NULL AND epoch(ts) >= {_EV_MID}"), ["psi"])

# ---------------------------------------------------------------- model operators
_FOLDP = f"fp AS ({DS.SCORED_SQL.replace('FROM orders o', 'FROM orders o')}), fp2 AS (" + \
    "SELECT listing_id, " + ", ".join(
        f"ln(1 + pred) + CAST((listing_id * {j}) % 7 AS DOUBLE) / 100 AS p{j}" for j in range(1, 6)) + " FROM fp)"
_MEAN = "(p1 + p2 + p3 + p4 + p5) / 5.0"
_SD = ("sqrt(((p1 - m) * (p1 - m) + (p2 - m) * (p2 - m) + (p3 - m) * (p3 - m) + (p4 - m) * (p4 - m) "
       "+ (p5 - m) * (p5 - m)) / 5.0)")
_INTERVAL = f"""WITH {_FOLDP},
i0 AS (SELECT *, {_MEAN} AS m FROM fp2),
i1 AS (SELECT *, {_SD} AS sd FROM i0),
i2 AS (SELECT listing_id, m AS log_mid, least(greatest(m - 1.5 * sd, m * 0.5), m) AS log_lo,
              greatest(m + 1.5 * sd, m) AS log_hi FROM i1),
i3 AS (SELECT *, greatest(exp(log_mid) - 1, 0) AS mid_price, greatest(exp(log_lo) - 1, 0) AS lo_p,
              greatest(exp(log_hi) - 1, 0) AS hi_p FROM i2)
SELECT listing_id, log_lo, log_mid, log_hi, least(lo_p, mid_price) AS lo_price, mid_price,
       greatest(hi_p, mid_price) AS hi_price FROM i3"""
oracle("m4", _INTERVAL, ["log_lo", "log_mid", "log_hi", "lo_price", "mid_price", "hi_price"])
oracle("m5", f"WITH {_FOLDP} SELECT listing_id, exp({_MEAN}) - 1 AS point_price FROM fp2", ["point_price"])
oracle("m6", f"WITH {_FOLDP} SELECT CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) AS n_rows "
             f"FROM fp2")
_m3_long = " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM train"
                              for c in _G12)
oracle("m3", f"WITH {DS.CLEAN_CTES}, {DS.ENC_CTES}, m3l AS ({_m3_long}) "
             "SELECT CAST(t.f AS INTEGER) AS target_fold, feature, quantile_cont(value, 0.01) AS clip_lo, "
             "quantile_cont(value, 0.99) AS clip_hi FROM m3l, range(5) t(f) WHERE m3l.fold <> t.f "
             "AND value IS NOT NULL GROUP BY t.f, feature", ["clip_lo", "clip_hi"])

# ---------------------------------------------------------------- TF-IDF vocabulary
_TOKENS = "regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _vocab_sql(src, id_col, text, n_docs_sql):
    tok = _TOKENS.format(t=text)
    return f"""
toks AS (SELECT {id_col} AS d, {tok} AS t FROM {src}),
terms AS (SELECT d, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
            AS term FROM toks),
tf AS (SELECT d, term, count(*) AS tf FROM terms GROUP BY d, term),
st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY term),
nd AS ({n_docs_sql}),
kept AS (SELECT st.*, nd.n_docs FROM st, nd WHERE df >= 5 AND df <= 0.85 * nd.n_docs
         ORDER BY total_tf DESC, term ASC LIMIT 2000)
SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, term, df, total_tf,
       ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
FROM kept"""


oracle("t19", "WITH " + _vocab_sql("documents", "doc_id", "text", "SELECT count(*) AS n_docs FROM documents"),
       ["idf"])
oracle("t19_listings", f"WITH {DS.CLEAN_CTES}, {DS.ENC_CTES}, "
       + _vocab_sql("train", "listing_id", "desc_clean", "SELECT count(*) AS n_docs FROM train"), ["idf"])

_W_TOK = _TOKENS.format(t="text")
oracle("t19_weights", f"""
WITH v AS (WITH {_vocab_sql("documents", "doc_id", "text", "SELECT count(*) AS n_docs FROM documents")}),
wt AS (SELECT doc_id, {_W_TOK} AS t FROM documents),
wterms AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
           FROM wt),
raw_w AS (SELECT doc_id, (1.0 + ln(count(*))) * idf AS w FROM wterms JOIN v USING (term) GROUP BY doc_id, term, idf),
per_doc AS (SELECT doc_id, count(*) AS n_terms, sum(w) / sqrt(sum(w * w)) AS sum_weight FROM raw_w GROUP BY doc_id)
SELECT doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(sum_weight, 0.0) AS sum_weight,
       CAST(CASE WHEN n_terms > 0 THEN 1 ELSE 0 END AS DOUBLE) AS norm
FROM documents LEFT JOIN per_doc USING (doc_id)""", ["sum_weight", "norm"])

# ---------------------------------------------------------------- streaming
oracle("q1", DS.with_decide("SELECT listing_id, alert, confidence, confidence_score, reason, ratio, zone, "
                            "down_payment_warning FROM d14"), ["ratio"])
oracle("q2_stream", """
WITH b AS (
  SELECT to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP AS window_start, event_type, value FROM events)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, avg(value) AS avg_value
FROM b
GROUP BY ALL""", ["avg_value"])
oracle("q2_late", """
WITH r AS (SELECT min(epoch(ts)) AS a, max(epoch(ts)) AS z FROM events),
l AS (SELECT e.*, z, CASE WHEN epoch(ts) < (a + z) / 2 AND event_id % 2 = 0 THEN 0
        WHEN epoch(ts) >= (a + z) / 2 AND NOT (epoch(ts) >= z - 1800 AND event_id % 4 = 3) THEN 1 ELSE 2 END AS lot FROM events e, r),
w AS (SELECT max(epoch(ts)) - 3600 AS mark FROM l WHERE lot < 2)
SELECT CASE WHEN lot = 2 AND epoch(ts) < mark THEN 'late' ELSE 'accepted' END AS outcome, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       count(*) AS n, count(*) AS n_events
FROM l, w GROUP BY ALL""")
oracle("q2_feedback_stream", with_fb("SELECT date_trunc('day', TIMESTAMP '2024-01-01' + to_minutes(listing_id))::TIMESTAMP AS "
                                     "window_start, type, alert, confidence, count(*) AS n, avg(CAST(feedback = 'up' AS DOUBLE)) "
                                     "AS up_share, sum(CAST(round(abs(price - predicted) / price * 1e6) AS BIGINT)) / count(*) / 1e6 AS mean_ape FROM fb GROUP BY ALL"),
       ["up_share", "mean_ape"])

# ---------------------------------------------------------------- decision helpers
_AMEN = " OR ".join(f"{c} = 1" for c in R.COVERAGE_AMENITIES)
oracle("d13", with_clean(f"""
SELECT listing_id, CAST(least(100,
    CASE WHEN building_age IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN floor_level IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN {_AMEN} THEN 20 ELSE 0 END + CASE WHEN condition_score IS NOT NULL THEN 15 ELSE 0 END
  + CASE WHEN coalesce(view_score, 0) > 0 THEN 10 ELSE 0 END
  + CASE WHEN down_payment_ratio IS NOT NULL OR is_installment = 1 OR is_cash = 1 THEN 15 ELSE 0 END) AS DOUBLE)
  AS coverage_score
FROM ({_CONTENT_CLEAN}) x"""), ["coverage_score"])
_DEVS = " OR ".join(f"contains(lower(coalesce(r.description, '')), '{d}')" for d in R.PREMIUM_DEVELOPERS)
oracle("d16", with_clean(f"""
SELECT c.listing_id,
  CASE WHEN c.city = 'Unknown' THEN
    CASE WHEN r.location IS NULL OR trim(string_split(r.location, ',')[-1]) = '' THEN 'Unknown'
         ELSE trim(string_split(r.location, ',')[-1]) END
  ELSE c.city END AS area,
  CASE WHEN c.size_sqm IS NOT NULL THEN 'present' ELSE 'missing' END AS land_size,
  CASE WHEN c.is_compound = 1 THEN 'yes' ELSE 'no' END AS in_compound,
  CASE WHEN contains(lower(coalesce(r.description, '')), 'pool')
         OR contains(lower(coalesce(r.description, '')), 'swimming') THEN 'yes' ELSE 'no' END AS has_pool,
  CASE WHEN {_DEVS} THEN 'premium' ELSE 'unknown' END AS developer_level
FROM (SELECT {CLEAN_COLUMNS_SQL} FROM clean) c JOIN raw r ON c.listing_id = r.listing_id"""))
oracle("d17", f"""
WITH s AS ({DS.SCORED_SQL}),
v AS (SELECT listing_id, ask, CASE WHEN pred IS NOT NULL AND pred > 0 THEN pred ELSE size_sqm * 36500 END AS quick_pred
      FROM s)
SELECT listing_id, quick_pred,
  CAST(printf('%.2f', quick_pred * 0.9 / 1000000) AS DOUBLE) AS min_range_m,
  CAST(printf('%.2f', quick_pred * 1.1 / 1000000) AS DOUBLE) AS max_range_m,
  CASE WHEN ask < quick_pred * 0.85 THEN 'GOOD DEAL' WHEN ask > quick_pred * 1.15 THEN 'OVERPRICED' ELSE 'FAIR' END
    AS quick_alert,
  'السعر ضمن النطاق المتوقع (' || regexp_replace(printf('%.2f', quick_pred * 0.9 / 1000000), '0$', '') || 'M-'
    || regexp_replace(printf('%.2f', quick_pred * 1.1 / 1000000), '0$', '') || 'M) للعقارات المشابهة.' AS quick_reason
FROM v""", ["quick_pred", "min_range_m", "max_range_m"])


def _align_sql():
    cols = []
    for name in R.MUST_KEEP + ["amenity_count"]:
        n = name.lower()
        if "bedroom" in n:
            v = "CAST(c.bedrooms_n AS DOUBLE)"
        elif "bathroom" in n:
            v = "CAST(c.bathrooms_n AS DOUBLE)"
        elif "size" in n or "sqm" in n:
            v = "CAST(c.size_sqm AS DOUBLE)"
        elif "amenit" in n:
            v = "CAST(coalesce(len(string_split_regex(NULLIF(f.active_features, ''), ',')), 0) AS DOUBLE)"
        else:
            v = "0.0"
        cols.append(f"{v} AS {name}")
    return ", ".join(cols)


oracle("d18", with_clean(f"""
SELECT c.listing_id, {_align_sql()}
FROM (SELECT {CLEAN_COLUMNS_SQL} FROM clean) c
JOIN (SELECT listing_id, {_ACTIVE} AS active_features FROM ({_RENTAL_FEATS}) z) f ON c.listing_id = f.listing_id"""),
       R.MUST_KEEP + ["amenity_count"])

# ---------------------------------------------------------------- single-operator keys
oracle("c5", with_clean("SELECT listing_id, bathrooms_n FROM s6"), ["bathrooms_n"])
oracle("c6", with_clean("SELECT listing_id, has_maid FROM s6"))
oracle("c11", with_clean("SELECT listing_id, desc_clean FROM s6"))
oracle("c16", with_clean("SELECT listing_id, view_score FROM s6"), ["view_score"])
oracle("c20", with_clean("SELECT listing_id, compound_tier FROM s6"), ["compound_tier"])
oracle("c21", with_clean("SELECT listing_id, standalone_premium, compound_premium FROM s6"))
oracle("c23", with_clean("SELECT listing_id, size_bucket FROM s6"))
oracle("t2", with_clean(f"SELECT listing_id, desc_len, nlp_score FROM (SELECT listing_id, {TS.kw_select()} FROM s6) k"),
       ["desc_len", "nlp_score"])
oracle("s2", DS.with_enc("""
SELECT 'te_map' AS artefact, (SELECT count(*) FROM (""" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}', {c} FROM train WHERE {c} IS NOT NULL" for c in _TE) + """)) AS n_rows
UNION ALL SELECT 'te_gm', CAST(1 AS BIGINT) UNION ALL SELECT 'pps_map', (SELECT count(*) FROM pps_map)
UNION ALL SELECT 'pps_gm', CAST(1 AS BIGINT) UNION ALL SELECT 'rarity', (SELECT count(*) FROM rarity)"""))
oracle("s3", ORACLE["g10"][0], ORACLE["g10"][1])
oracle("s5", with_clean(f"SELECT listing_id, type_fixed AS type_clean, compound, price_egp FROM clean "
                        "ORDER BY listing_id LIMIT 5"), ["price_egp"])

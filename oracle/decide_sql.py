"""DuckDB oracle CTEs for encodings (G5-G12) and decisions."""

from oracle.clean_sql import CLEAN_COLUMNS_SQL, CLEAN_CTES
from propval.functions import rules as R
from propval.sources.fixtures import SCORED_SQL


def case_map(expr, mapping, default="NULL"):
    """Lookup as a CASE; numbers come out as DOUBLE like Python floats (not DECIMAL)."""
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {expr} {whens} ELSE {default} END AS DOUBLE)"


def price_text(x):
    return (f"CASE WHEN {x} >= 1000000 THEN rtrim(rtrim(printf('%.2f', {x} / 1000000.0), '0'), '.') || 'M' "
            f"WHEN {x} >= 1000 THEN printf('%.0f', {x} / 1000.0) || 'K' "
            f"WHEN printf('%.0f', {x}) = '1000' THEN '1,000' ELSE printf('%.0f', {x}) END")


ENC_CTES = f"""
enc_base AS (
  SELECT c.*,
    compound || '_' || type_clean AS comp_type,
    CAST(CAST(coalesce(bedrooms_n, 0) AS BIGINT) AS VARCHAR) || '_' || type_clean AS bed_type,
    CAST(CAST(regexp_matches(lower(desc_clean), 'north\\s*coast|ras\\s*el?\\s*hekma|sahel') AS INTEGER) AS VARCHAR)
      || '_' || type_clean AS nc_type,
    CAST(CAST(coalesce(finish_ord, -1) AS BIGINT) AS VARCHAR) || '_' || type_clean AS finish_type,
    type_clean || '_' || CAST(CAST(market_tier AS BIGINT) AS VARCHAR) AS type_tier,
    listing_id % 5 = 0 AS is_test,
    CAST((listing_id // 5) % 5 AS INTEGER) AS fold,
    log_price - ln(1 + CASE WHEN size_sqm IS NOT NULL THEN greatest(size_sqm, 1.0) END) AS lpps
  FROM (SELECT {CLEAN_COLUMNS_SQL} FROM clean) c
),
train AS (SELECT * FROM enc_base WHERE NOT is_test),
test AS (SELECT * FROM enc_base WHERE is_test),
te_gm AS (SELECT avg(log_price) AS gm FROM train),
pps_gm AS (SELECT quantile_cont(lpps, 0.5) AS pps_gm FROM train),
pps_map AS (SELECT city, type_clean, quantile_cont(lpps, 0.5) AS lpps FROM train GROUP BY city, type_clean),
rarity AS (SELECT city, type_clean, 1.0 / (count(*) + 1.0) AS rarity FROM train GROUP BY city, type_clean)
"""


def te_oof_sql(col: str, k: int) -> str:
    """Out-of-fold smoothed mean of log_price for one column (train rows)."""
    return f"""
SELECT a.listing_id,
  (coalesce(sum(b.log_price), 0) + {k}.0 * (SELECT gm FROM te_gm)) / (count(b.listing_id) + {k}.0) AS {col}_te
FROM train a LEFT JOIN train b ON a.{col} = b.{col} AND a.fold <> b.fold
GROUP BY a.listing_id"""


def te_full_sql(col: str, k: int) -> str:
    """Frozen full-train encoding applied to test rows."""
    return f"""
SELECT t.listing_id,
  coalesce(m.v, (SELECT gm FROM te_gm)) AS {col}_te
FROM test t LEFT JOIN (
  SELECT {col} AS key, (sum(log_price) + {k}.0 * (SELECT gm FROM te_gm)) / (count(*) + {k}.0) AS v
  FROM train GROUP BY {col}) m ON t.{col} = m.key"""


PPS_OOF_SQL = """
SELECT a.listing_id,
  CASE WHEN count(b.listing_id) > 0 THEN quantile_cont(b.lpps, 0.5) ELSE (SELECT pps_gm FROM pps_gm) END
    AS price_per_sqm_estimate
FROM train a LEFT JOIN train b ON a.city = b.city AND a.type_clean = b.type_clean AND a.fold <> b.fold
GROUP BY a.listing_id"""

PPS_TEST_SQL = """
SELECT t.listing_id,
  CASE WHEN m.city IS NOT NULL THEN m.lpps ELSE (SELECT pps_gm FROM pps_gm) END AS price_per_sqm_estimate
FROM test t LEFT JOIN pps_map m ON t.city = m.city AND t.type_clean = m.type_clean"""


_MAPE = case_map("type_clean", R.MAPE_BY_TYPE, str(R.DEFAULT_MAPE))
_BASE = case_map("type_clean", R.BASE_CONFIDENCE, str(R.DEFAULT_BASE_CONFIDENCE))
_REL = case_map("type_clean", R.TYPE_RELIABILITY, "1.0")
_PREMIUM = " OR ".join(f"contains(a_l, '{c}')" for c in R.PREMIUM_CITIES)
_DISCOUNT = " ".join(f"WHEN contains(a_l, '{c}') THEN {d}" for c, d in R.STANDALONE_CALIBRATION)
_VF = {z: m / R.VILLA_CLUSTER_OVERALL_MEDIAN for z, m in R.VILLA_CLUSTER_MEDIAN_P50.items()}


def _ar(template, lo="low_t", hi="high_t"):
    a, b = template.split("{lo}")
    b1, b2 = b.split("{hi}")
    return f"'{a}' || {lo} || '{b1}' || {hi} || '{b2}'"


DECIDE_CTES = f"""
dec_in AS (
  SELECT s.listing_id, s.ask, s.pred, s.lo, s.hi, s.type_clean, s.city AS area, s.in_compound,
         s.developer_level, s.has_pool, CASE WHEN s.size_sqm IS NULL THEN 'missing' ELSE 'present' END AS land_size,
         r.description AS "desc", r.compound, s.size_sqm
  FROM ({SCORED_SQL}) s LEFT JOIN s6 r ON s.listing_id = r.listing_id
),
d1 AS (
  SELECT *, CAST(CASE WHEN in_compound = 'yes' THEN 1.041 ELSE 1.051 END AS DOUBLE) AS bias_f, lower(coalesce(CAST(area AS VARCHAR), 'nan')) AS a_l
  FROM dec_in
),
d2 AS (
  SELECT *, pred / bias_f AS pred_b, lo / bias_f AS lo_b, hi / bias_f AS hi_b,
    CAST(CASE WHEN in_compound = 'yes' THEN 1.0 WHEN NOT ({_PREMIUM}) THEN 1.0
         {_DISCOUNT} ELSE {R.DEFAULT_STANDALONE_DISCOUNT} END AS DOUBLE) AS discount
  FROM d1
),
d3 AS (
  SELECT *,
    CASE WHEN discount >= 0.99 THEN pred_b ELSE exp(ln(1 + pred_b) + ln(discount)) - 1 END AS pred_c,
    CASE WHEN discount >= 0.99 THEN lo_b ELSE exp(ln(1 + lo_b) + ln(discount)) - 1 END AS lo_c,
    CASE WHEN discount >= 0.99 THEN hi_b ELSE exp(ln(1 + hi_b) + ln(discount)) - 1 END AS hi_c,
    CASE WHEN type_clean <> 'Villa' THEN ''
         WHEN regexp_matches(lower(coalesce(CAST(area AS VARCHAR), 'nan') || ' ' || coalesce("desc", '') || ' ' ||
              coalesce(compound, '')), '{R.COASTAL_PATTERNS}') THEN 'coastal'
         WHEN regexp_matches(lower(coalesce(CAST(area AS VARCHAR), 'nan') || ' ' || coalesce("desc", '') || ' ' ||
              coalesce(compound, '')), '{R.RED_SEA_PATTERNS}') THEN 'red_sea'
         ELSE 'urban' END AS zone
  FROM d2
),
d4 AS (
  SELECT *,
    CASE WHEN type_clean = 'Villa' THEN {case_map('zone', _VF, '1.0')} ELSE 1.0 END AS vf
  FROM d3
),
d5 AS (
  SELECT *, pred_c * vf AS pred_f, lo_c * vf AS lo_f, hi_c * vf AS hi_f,
    pred_c <> pred_b AS calibrated
  FROM d4
),
d6 AS (
  SELECT *,
    CASE WHEN pred_f > 0 THEN (hi_f - lo_f) / pred_f ELSE 0.0 END AS uncertainty,
    CASE WHEN pred_f > 0 THEN ask / pred_f ELSE 1.0 END AS ratio,
    CASE WHEN type_clean = 'Villa' THEN {case_map('zone', {z: t[0] for z, t in R.VILLA_ZONE_THRESHOLDS.items()}, '0.60')}
         ELSE 1.0 - {_MAPE} * 0.9 END AS lower0,
    CASE WHEN type_clean = 'Villa' THEN {case_map('zone', {z: t[1] for z, t in R.VILLA_ZONE_THRESHOLDS.items()}, '1.60')}
         ELSE 1.0 + {_MAPE} * 0.9 END AS upper0
  FROM d5
),
d7 AS (
  SELECT *,
    CASE WHEN uncertainty > 0.40 THEN lower0 * 0.90 WHEN uncertainty < 0.20 THEN lower0 * 0.97 ELSE lower0 END
      AS band_lower,
    CASE WHEN uncertainty > 0.40 THEN upper0 * 1.10 WHEN uncertainty < 0.20 THEN upper0 * 0.97 ELSE upper0 END
      AS band_upper
  FROM d6
),
d8 AS (
  SELECT *,
    CASE WHEN ask < lo_f THEN 'UNDERPRICED' WHEN ask > hi_f THEN 'OVERPRICED'
         WHEN ratio < band_lower THEN 'UNDERPRICED' WHEN ratio > band_upper THEN 'OVERPRICED'
         ELSE 'FAIR' END AS alert_raw,
    CASE WHEN type_clean = 'Villa' THEN
           CASE WHEN zone IN ('coastal', 'red_sea') THEN 50
                WHEN zone = 'urban' AND developer_level = 'premium' THEN 65 ELSE 55 END
         WHEN type_clean = 'Duplex' THEN least({_BASE}, 65)
         ELSE {_BASE} END AS base,
    (CASE WHEN land_size = 'missing' THEN CASE WHEN type_clean = 'Villa' THEN 15 ELSE 5 END ELSE 0 END
     + CASE WHEN in_compound = 'no' THEN CASE WHEN type_clean = 'Villa' THEN 5 ELSE 10 END ELSE 0 END
     + CASE WHEN developer_level = 'unknown' THEN 5 ELSE 0 END
     + CASE WHEN uncertainty > 0.40 THEN 10 ELSE 0 END) AS penalty,
    CASE WHEN ratio < band_lower THEN
           CAST(trunc(least(CASE WHEN band_lower > 0 THEN (band_lower - ratio) / band_lower ELSE 0 END * 60, 15.0)) AS INTEGER)
         WHEN ratio > band_upper THEN
           CAST(trunc(least(CASE WHEN band_upper > 0 THEN (ratio - band_upper) / band_upper ELSE 0 END * 60, 15.0)) AS INTEGER)
         WHEN (band_upper - band_lower) / 2 > 0 THEN
           -CAST(trunc(least(greatest(abs(ratio - (band_lower + band_upper) / 2) / ((band_upper - band_lower) / 2), 0.0), 1.0) * 15) AS INTEGER)
         ELSE 0 END AS boost
  FROM d7
),
d9 AS (
  SELECT *,
    least(greatest(CAST(trunc(least(greatest(base - penalty + boost, 20), 95) * {_REL}) AS INTEGER), 20), 95)
      AS conf_score_raw
  FROM d8
),
d10 AS (
  SELECT d9.*,
    CASE WHEN conf_score_raw >= 75 THEN 'HIGH' WHEN conf_score_raw >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS conf_level_raw,
    CASE WHEN ra.rarity IS NOT NULL THEN ra.rarity WHEN pm.city IS NULL THEN 0.7 ELSE 0.0 END AS rarity_score,
    CASE WHEN pm.city IS NOT NULL THEN pm.lpps ELSE (SELECT pps_gm FROM pps_gm) END AS log_pps
  FROM d9
  LEFT JOIN rarity ra ON trim(CAST(d9.area AS VARCHAR)) = ra.city AND trim(d9.type_clean) = ra.type_clean
  LEFT JOIN pps_map pm ON trim(CAST(d9.area AS VARCHAR)) = pm.city AND trim(d9.type_clean) = pm.type_clean
),
d11 AS (
  SELECT *,
    CASE WHEN rarity_score >= 0.5 THEN 15 WHEN rarity_score >= 0.3 THEN 8 ELSE 0 END AS rarity_penalty,
    rarity_score >= 0.3 AS is_rare,
    CASE WHEN size_sqm > 0 AND exp(log_pps) * size_sqm > 0 AND isfinite(exp(log_pps) * size_sqm)
         THEN pred_f / (exp(log_pps) * size_sqm) ELSE 1.0 END AS benchmark_deviation,
    coalesce(size_sqm > 0 AND exp(log_pps) * size_sqm > 0 AND isfinite(exp(log_pps) * size_sqm)
             AND (pred_f / (exp(log_pps) * size_sqm) > 1.8 OR pred_f / (exp(log_pps) * size_sqm) < 0.4), false)
      AS is_unrealistic
  FROM d10
),
d12 AS (
  SELECT *,
    ratio < 0.4 OR ratio > 2.0 AS extreme,
    greatest(20, conf_score_raw - rarity_penalty - CASE WHEN is_unrealistic THEN 25 ELSE 0 END) AS adj
  FROM d11
),
d13 AS (
  SELECT *,
    CASE WHEN extreme THEN alert_raw WHEN is_rare OR is_unrealistic THEN 'FAIR' ELSE alert_raw END AS alert,
    CASE WHEN extreme OR is_rare OR is_unrealistic THEN least(adj, 35) ELSE adj END AS confidence_score,
    CASE WHEN extreme OR is_rare OR is_unrealistic THEN 'LOW' WHEN adj < 50 THEN 'LOW' WHEN adj < 75 THEN 'MEDIUM'
         ELSE 'HIGH' END AS confidence,
    {price_text('lo_f')} AS low_t, {price_text('hi_f')} AS high_t,
    abs(ratio - 1.0) * 100 AS dev_pct
  FROM d12
),
d14 AS (
  SELECT *,
    'Similar ' || CASE zone WHEN 'coastal' THEN 'Coastal ' WHEN 'red_sea' THEN 'Red Sea ' ELSE '' END
      || lower(type_clean) || 's in '
      || CASE WHEN area IS NOT NULL AND CAST(area AS VARCHAR) <> '' AND CAST(area AS VARCHAR) <> 'Unknown'
              THEN CAST(area AS VARCHAR) ELSE 'similar locations' END
      || ' typically sell between ' || low_t || ' and ' || high_t || '. Your price is '
      || CASE WHEN alert IN ('UNDERPRICED', 'OVERPRICED') AND dev_pct >= 25 THEN
              'significantly ' || CASE WHEN alert = 'UNDERPRICED' THEN 'lower' ELSE 'higher' END
              || ' than the market range (' || low_t || '–' || high_t || '). Your price is ~'
              || printf('%.0f', dev_pct) || '% ' || CASE WHEN ratio < 1.0 THEN 'below' ELSE 'above' END
              || ' expected value, placing it among the ' || CASE WHEN ratio < 1.0 THEN 'lowest ' ELSE 'highest ' END
              || CAST(least(greatest(CAST(trunc(abs(ratio - 1.0) * 100) AS INTEGER), 1), 50) AS VARCHAR)
              || '% of comparable listings.'
            WHEN alert IN ('UNDERPRICED', 'OVERPRICED') THEN
              CASE WHEN alert = 'UNDERPRICED' THEN 'lower' ELSE 'higher' END
              || ' than most comparable listings in the ' || low_t || '–' || high_t || ' range.'
            ELSE 'generally in line with the market range of ' || low_t || '–' || high_t || '.' END
      || CASE WHEN calibrated THEN ' (Standalone area pricing applied.)' ELSE '' END
      || chr(10) || chr(10)
      || CASE WHEN alert = 'UNDERPRICED' AND ratio < 0.4 THEN {_ar(R.AR_UNDER_EXTREME)}
              WHEN alert = 'UNDERPRICED' THEN {_ar(R.AR_UNDER)}
              WHEN alert = 'OVERPRICED' AND ratio > 2.0 THEN {_ar(R.AR_OVER_EXTREME)}
              WHEN alert = 'OVERPRICED' THEN {_ar(R.AR_OVER)}
              ELSE {_ar(R.AR_FAIR)} END
      || chr(10)
      || CASE WHEN (is_rare OR is_unrealistic) AND confidence = 'LOW' THEN '{R.AR_WEAK_DATA}'
              WHEN confidence = 'LOW' THEN '{R.AR_LOW}' WHEN confidence = 'MEDIUM' THEN '{R.AR_MEDIUM}'
              ELSE '{R.AR_HIGH}' END
      || CASE WHEN has_pool = 'yes' AND developer_level = 'premium'
              THEN ' {R.REASON_POOL_NOTE} {R.REASON_DEVELOPER_NOTE}'
              WHEN has_pool = 'yes' THEN ' {R.REASON_POOL_NOTE}'
              WHEN developer_level = 'premium' THEN ' {R.REASON_DEVELOPER_NOTE}' ELSE '' END AS reason,
    CASE WHEN (CASE WHEN pred > 0 THEN ask / pred ELSE 1.0 END) < 0.35 THEN
      '⚠️ Alert: The entered price (' || {price_text('ask')} || ') equals '
      || printf('%.0f', (CASE WHEN pred > 0 THEN ask / pred ELSE 1.0 END) * 100)
      || '% of the expected price. Did you enter the down payment (≈' || {price_text('pred * 0.2')}
      || ') instead of the full price?' END AS down_payment_warning
  FROM d13
)
"""


def with_decide(select_sql: str) -> str:
    return f"WITH {CLEAN_CTES}, {ENC_CTES}, {DECIDE_CTES}\n{select_sql}"


def with_enc(select_sql: str) -> str:
    return f"WITH {CLEAN_CTES}, {ENC_CTES}\n{select_sql}"

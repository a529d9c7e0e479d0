"""DuckDB oracle SQL for the cleaning job (written against the rule semantics).

RE2 notes: ``\\b``, ``\\d``, ``\\s``, ``\\w`` are ASCII-only, so Arabic word
boundaries are spelled out with ``[^\\p{L}\\p{N}_]``. DuckDB ``round`` is
half-up, so Python-style rounding uses ``printf('%.1f')``.
"""

from propval.functions import rules as R
from propval.sources.fixtures import LISTINGS_SQL

AR_WORD = lambda w: f"(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])"


def _in_list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


LUX = R.KNOWN_LUXURY_COMPOUNDS
MID = R.KNOWN_MID_COMPOUNDS
STANDALONE = R.STANDALONE_KEYWORDS

COMPOUND_RE = "\\bcompound\\b|" + AR_WORD("كمبوند") + "|" + AR_WORD("مجمع")

TYPE_CASE = """CASE lower(trim({c}))
  WHEN 'apartment' THEN 'Apartment' WHEN 'villa' THEN 'Villa' WHEN 'penthouse' THEN 'Penthouse'
  WHEN 'duplex' THEN 'Duplex' WHEN 'chalet' THEN 'Chalet'
  WHEN 'شقة' THEN 'Apartment' WHEN 'شقه' THEN 'Apartment' WHEN 'شقا' THEN 'Apartment'
  WHEN 'فيلا' THEN 'Villa' WHEN 'فيله' THEN 'Villa' WHEN 'شاليه' THEN 'Chalet' WHEN 'شليه' THEN 'Chalet'
  WHEN 'دوبلكس' THEN 'Duplex' WHEN 'دوبليكس' THEN 'Duplex' WHEN 'بنتهاوس' THEN 'Penthouse'
  WHEN 'رووف' THEN 'Penthouse' WHEN 'روف' THEN 'Penthouse'
  WHEN 'ivilla' THEN 'Villa' WHEN 'twin house' THEN 'Villa' WHEN 'townhouse' THEN 'Villa'
  WHEN 'twin villa' THEN 'Villa' WHEN 'standalone villa' THEN 'Villa' END"""


def any_contains(expr, words):
    return f"len(list_filter([{_in_list(words)}], lambda w: contains({expr}, w))) > 0"


# Stage-by-stage CTEs. `raw` is the listings fixture.
CLEAN_CTES = f"""
raw AS ({LISTINGS_SQL}),
s0 AS (
  SELECT *,
    CASE WHEN contains(lower(coalesce(url, 'nan')), '/plp/rent/') THEN 'rent' ELSE 'buy' END AS listing_type,
    TRY_CAST(regexp_replace(coalesce(price, 'nan'), '[^0-9.]', '', 'g') AS DOUBLE) AS price_egp
  FROM raw
),
s2 AS (
  SELECT s0.*, ln(1 + price_egp) AS log_price,
    trim(lower(coalesce(size, 'nan'))) AS size_txt,
    lower(coalesce(payment_method, '')) AS pay_txt,
    replace(lower(down_payment), ',', '') AS dp_txt,
    coalesce(type, 'Other') AS type_raw,
    regexp_replace(coalesce(description, ''), 'http\\S+|www\\.\\S+', ' ', 'g') AS desc_clean,
    list_transform(string_split(location, ','), lambda x: trim(x)) AS loc_parts
  FROM s0
),
s3 AS (
  SELECT *,
    regexp_extract(size_txt, '([0-9,]+(\\.[0-9]+)?)\\s*sqm', 1) AS g_sqm,
    regexp_extract(size_txt, '([0-9,]+(\\.[0-9]+)?)\\s*sqft', 1) AS g_sqft,
    regexp_extract(size_txt, '([0-9,]+(\\.[0-9]+)?)', 1) AS g_bare,
    TRY_CAST(NULLIF(regexp_extract(coalesce(bedrooms, 'nan'), '([0-9]+)', 1), '') AS DOUBLE) AS bedrooms_n,
    TRY_CAST(trim(bathrooms) AS DOUBLE) AS bathrooms_n,
    CAST(contains(lower(coalesce(bedrooms, '')), 'maid') AS INTEGER) AS has_maid,
    CAST(regexp_matches(pay_txt, 'install|قسط|تقسيط') AS INTEGER) AS is_installment,
    CAST(regexp_matches(pay_txt, '\\bcash\\b|كاش') AS INTEGER) AS is_cash,
    CASE WHEN down_payment IS NOT NULL THEN
      TRY_CAST(NULLIF(regexp_extract(dp_txt, '([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE)
      * CASE WHEN regexp_matches(dp_txt, '\\bm\\b|million|مليون') THEN 1000000.0
             WHEN regexp_matches(dp_txt, '\\bk\\b|thousand|الف|ألف') THEN 1000.0 ELSE 1.0 END
    END AS dp_value,
    CASE WHEN location IS NULL THEN 'Unknown' ELSE loc_parts[1] END AS compound,
    CASE WHEN location IS NULL THEN 'Unknown' WHEN len(loc_parts) >= 3 THEN loc_parts[len(loc_parts) - 1]
         ELSE loc_parts[1] END AS city,
    CASE WHEN location IS NULL THEN 'Unknown' WHEN len(loc_parts) >= 2 THEN loc_parts[len(loc_parts)]
         ELSE loc_parts[1] END AS governorate,
    lower(desc_clean) AS d
  FROM s2
),
s4 AS (
  SELECT *,
    CASE WHEN g_sqm <> '' THEN TRY_CAST(replace(g_sqm, ',', '') AS DOUBLE)
         WHEN g_sqft <> '' THEN TRY_CAST(replace(g_sqft, ',', '') AS DOUBLE) * CAST(0.0929 AS DOUBLE)
         WHEN g_bare <> '' THEN TRY_CAST(replace(g_bare, ',', '') AS DOUBLE) END AS size_raw,
    (g_sqm <> '' OR g_sqft <> '') AS size_rounds,
    dp_value / NULLIF(price_egp, 0) AS dp_ratio_raw,
    CASE WHEN dp_value IS NOT NULL THEN ln(1 + CASE WHEN dp_value > 0 THEN dp_value ELSE 0 END) END
      AS log_down_payment,
    bathrooms_n / NULLIF(bedrooms_n, 0) AS room_ratio,
    TRY_CAST(NULLIF(regexp_extract(d, '([0-9]+)\\s*year', 1), '') AS DOUBLE) AS yr_raw,
    CASE WHEN regexp_matches(d, 'luxury.?finish|super.?lux') THEN 3.0
         WHEN regexp_matches(d, 'fully.?finish|full.?finish') THEN 2.0
         WHEN regexp_matches(d, 'semi.?finish') THEN 1.0
         WHEN regexp_matches(d, 'core.?shell|bare.?shell|unfinished') THEN 0.0 END AS finish_ord,
    CASE WHEN regexp_matches(d, 'golf.?view|golf.?course') THEN 5.0
         WHEN regexp_matches(d, 'sea.?view|ocean.?view|panoramic.*sea') THEN 4.0
         WHEN regexp_matches(d, 'lagoon') THEN 3.0
         WHEN regexp_matches(d, 'garden.?view') THEN 2.0
         WHEN regexp_matches(d, 'pool.?view') THEN 1.0 ELSE 0.0 END AS view_score,
    lower(governorate) || ' ' || lower(city) || ' ' || lower(compound) AS tier_blob,
    lower(city) || ' ' || lower(compound) || ' ' || d AS zone_blob,
    lower(trim(compound)) AS comp_l
  FROM s3
),
s5 AS (
  SELECT *,
    CASE WHEN size_raw >= 5 AND size_raw <= 5000 THEN
      CASE WHEN size_rounds THEN CAST(printf('%.1f', size_raw) AS DOUBLE) ELSE size_raw END END AS size_sqm,
    CASE WHEN dp_ratio_raw > 0 AND dp_ratio_raw < 1 THEN dp_ratio_raw END AS down_payment_ratio,
    CASE WHEN yr_raw >= 2 AND yr_raw <= 25 THEN yr_raw END AS install_years,
    CASE WHEN regexp_matches(tier_blob, 'north\\s*coast|sahel|ras\\s*el?\\s*hekma|matrouh|gouna|sokhna') THEN 3.0
         WHEN regexp_matches(tier_blob, 'new\\s*cairo|5th\\s*settlement|fifth\\s*settlement|sheikh.?zayed|6th.?october|new\\s*capital') THEN 2.0
         WHEN regexp_matches(tier_blob, 'giza|maadi|zamalek|heliopolis|nasr\\s*city|mohandessin') THEN 1.0
         ELSE 0.0 END AS market_tier,
    CASE WHEN regexp_matches(zone_blob, 'north\\s*coast|sahel|ras\\s*el?\\s*hekma|matrouh|marsa\\s*matrouh|el\\s*alamein|hacienda|marassi|amwaj|bo\\s*island|jefaira') THEN 'coastal'
         WHEN regexp_matches(zone_blob, 'sokhna|ain\\s*sokhna|red\\s*sea|ghardaqa|hurghada|sharm\\s*el\\s*sheikh|dahab|porto\\s*sokhna|mountain\\s*view\\s*sokhna') THEN 'red_sea'
         ELSE 'urban' END AS area_market_zone,
    CAST((comp_l IN ({_in_list(LUX + MID)}) OR regexp_matches(comp_l, '{COMPOUND_RE}')
          OR regexp_matches(d, '{COMPOUND_RE}'))
         AND NOT (comp_l IN ('', '-', 'unknown', 'na', 'n/a', 'other', 'none') OR compound IS NULL
                  OR length(comp_l) < 3 OR {any_contains('comp_l', STANDALONE)}
                  OR {any_contains('d', STANDALONE)}) AS INTEGER) AS is_compound,
    CASE WHEN comp_l IN ({_in_list(LUX)}) OR {any_contains('d', LUX)} THEN 2.0
         WHEN comp_l IN ({_in_list(MID)}) OR {any_contains('d', MID)} THEN 1.0 ELSE 0.0 END AS compound_tier
  FROM s4
),
s6 AS (
  SELECT *,
    CASE area_market_zone WHEN 'coastal' THEN 1.0 WHEN 'red_sea' THEN 2.0 ELSE 0.0 END AS area_market_zone_ord,
    CAST(is_compound = 0 AND market_tier >= 2 AS INTEGER) AS standalone_premium,
    CAST(is_compound = 1 AND compound_tier = 2 AS INTEGER) AS compound_premium,
    CASE WHEN size_sqm IS NOT NULL THEN ln(1 + greatest(size_sqm, 1.0)) END AS log_size_sqm,
    CASE WHEN size_sqm IS NOT NULL THEN 1.0 / greatest(size_sqm, 1.0) END AS size_sqm_inv,
    size_sqm / NULLIF(bedrooms_n, 0) AS size_per_bedroom,
    coalesce(size_sqm, 0) * coalesce(finish_ord, 0) AS size_x_finish,
    CASE WHEN size_sqm < 80 THEN 'small' WHEN size_sqm < 150 THEN 'medium' WHEN size_sqm < 250 THEN 'large'
         ELSE 'xlarge' END AS size_bucket,
    CASE WHEN type_raw = 'Apartment' AND regexp_matches(d, '\\bvilla\\b|فيلا|توين هاوس|تاون هاوس|i?villa')
              AND size_sqm > 400 THEN 'Villa'
         WHEN type_raw = 'Apartment' AND regexp_matches(d, '\\bduplex\\b|دوبلكس|دوبليكس') THEN 'Duplex'
         WHEN type_raw = 'Apartment' AND regexp_matches(d, '\\bpenthouse\\b|بنتهاوس') THEN 'Penthouse'
         ELSE type_raw END AS type_kw,
    CASE WHEN size_sqm > 0 AND size_sqm <= 80 THEN 'small' WHEN size_sqm > 80 AND size_sqm <= 150 THEN 'medium'
         WHEN size_sqm > 150 AND size_sqm <= 250 THEN 'large' WHEN size_sqm > 250 AND size_sqm <= 9999 THEN 'xlarge'
    END AS fence_bin,
    price_egp / CASE WHEN size_sqm IS NOT NULL THEN greatest(size_sqm, 1.0) END AS ppsm
  FROM s5
),
valid AS (SELECT * FROM s6 WHERE price_egp IS NOT NULL),
trim_bounds AS (SELECT quantile_cont(price_egp, 0.05) AS q_lo, quantile_cont(price_egp, 0.95) AS q_hi FROM valid),
trimmed AS (
  SELECT valid.* EXCLUDE (q_lo, q_hi), ln(1 + count(*) OVER (PARTITION BY compound)) AS log_comp_size
  FROM (SELECT * FROM valid, trim_bounds) valid
  WHERE price_egp >= q_lo AND price_egp <= q_hi
),
apts AS (SELECT * FROM trimmed WHERE type_kw = 'Apartment'),
fences AS (
  SELECT city AS f_city, fence_bin AS f_bin,
         quantile_cont(ppsm, 0.75) + 3.0 * (quantile_cont(ppsm, 0.75) - quantile_cont(ppsm, 0.25)) AS upper_fence
  FROM apts WHERE fence_bin IS NOT NULL AND ppsm IS NOT NULL
  GROUP BY city, fence_bin
  HAVING count(ppsm) >= 10 AND (SELECT count(*) FROM apts) >= 100
),
s7 AS (
  SELECT trimmed.*,
    coalesce(type_kw = 'Apartment' AND ppsm > upper_fence
             AND (size_sqm > 300 OR contains(d, 'penthouse')), false) AS suspicious
  FROM trimmed LEFT JOIN fences ON trimmed.city = fences.f_city AND trimmed.fence_bin = fences.f_bin
),
s8 AS (
  SELECT *,
    CASE WHEN suspicious AND contains(d, 'penthouse') THEN 'Penthouse'
         WHEN suspicious AND size_sqm > 350 THEN 'Villa'
         WHEN suspicious AND size_sqm > 250 THEN 'Duplex'
         ELSE type_kw END AS type_fixed,
    city || '_comp' || CAST(is_compound AS VARCHAR) AS city_comp,
    governorate || '_comp' || CAST(is_compound AS VARCHAR) AS governorate_comp
  FROM s7
),
clean AS (
  SELECT * REPLACE ({TYPE_CASE.format(c='type_fixed')} AS type_fixed)
  FROM s8
  WHERE {TYPE_CASE.format(c='type_fixed')} IS NOT NULL
)
"""

CLEAN_COLUMNS_SQL = """listing_id, listing_type, price_egp, log_price, size_sqm, bedrooms_n, bathrooms_n, has_maid,
  is_installment, is_cash, down_payment_ratio, log_down_payment, type_fixed AS type_clean, desc_clean, room_ratio,
  compound, city, governorate, install_years, log_comp_size, finish_ord, view_score, market_tier, area_market_zone,
  area_market_zone_ord, is_compound, compound_tier, standalone_premium, compound_premium, log_size_sqm,
  size_sqm_inv, size_per_bedroom, size_x_finish, size_bucket, city_comp, governorate_comp"""


def with_clean(select_sql: str) -> str:
    """Wrap a query over the `clean` CTE (and the stage CTEs)."""
    return f"WITH {CLEAN_CTES}\n{select_sql}"

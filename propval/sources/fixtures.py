"""Fixture views derived from the driver's parquet tables.

The SQL texts below run unchanged in Spark SQL and in DuckDB, so the oracle
and the Spark job see byte-identical inputs. ``listings`` is a raw, dirty
listing table (all text columns); ``scored`` holds the inputs of the decision,
rental and payment operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from propval.sources.tables import read_table

LISTINGS_SQL = """
WITH base AS (
  SELECT o.o_orderkey AS k, o.o_totalprice AS tp, o.o_orderdate AS od,
         n.n_name AS nat, r.r_name AS reg,
         30 + (o.o_orderkey * 37) % 420 AS sz
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n   ON c.c_nationkey = n.n_nationkey
  JOIN region r   ON n.n_regionkey = r.r_regionkey
), priced AS (
  SELECT base.*,
         CASE WHEN k % 10 < 6 THEN 'Apartment' WHEN k % 10 = 6 THEN 'iVilla'
              WHEN k % 10 = 7 THEN 'Duplex'    WHEN k % 10 = 8 THEN 'شاليه'
              WHEN k % 20 = 9 THEN 'Penthouse' ELSE 'Land' END AS ptype,
         CAST(floor((tp * 2 + sz * 20000)
              * CASE WHEN k % 10 = 6 THEN 14 WHEN k % 97 = 0 THEN 6 ELSE 1 END) AS BIGINT) AS p
  FROM base
)
SELECT k AS listing_id,
       concat('https://x.example/plp/', CASE WHEN k % 5 = 0 THEN 'rent' ELSE 'buy' END, '/', CAST(k AS STRING)) AS url,
       CASE WHEN k % 331 = 0 THEN 'Ask' ELSE concat('EGP ', CAST(p AS STRING)) END AS price,
       CASE WHEN k % 41 = 0 THEN NULL
            WHEN k % 7 = 0 THEN concat(CAST(sz * 10 AS STRING), ' sqft')
            WHEN k % 7 = 1 THEN CAST(sz AS STRING)
            ELSE concat(CAST(sz AS STRING), ' sqm') END AS size,
       CASE WHEN k % 17 = 0 THEN 'studio' WHEN k % 13 = 0 THEN '4 + Maid' ELSE CAST(1 + k % 6 AS STRING) END AS bedrooms,
       CASE WHEN k % 19 = 0 THEN '7+' ELSE CAST(1 + k % 4 AS STRING) END AS bathrooms,
       CASE WHEN k % 3 = 0 THEN 'Cash' WHEN k % 3 = 1 THEN 'Installments' ELSE 'قسط او كاش' END AS payment_method,
       CASE WHEN k % 4 = 0 THEN '1.5 million' WHEN k % 4 = 1 THEN '500 k' WHEN k % 4 = 2 THEN '250,000' ELSE NULL END AS down_payment,
       ptype AS type,
       CASE WHEN k % 29 = 0 THEN NULL
            WHEN k % 3 = 0 THEN concat('mivida, ', nat, ', ', reg)
            WHEN k % 3 = 1 THEN concat(nat, ', New Cairo, ', reg)
            ELSE concat('North Coast, ', reg) END AS location,
       (CASE k % 12
         WHEN 0 THEN 'Fully finished penthouse with sea view, 3rd floor, elevator and garage!'
         WHEN 1 THEN 'Core & shell duplex, under construction, delivery in 2028, 8 years installment'
         WHEN 2 THEN 'شقة في عمارة الدور الثالث مصعد و جراج'
         WHEN 3 THEN 'Brand new compound unit, golf view, pool, gated, near metro. Call 01001234567'
         WHEN 4 THEN 'Standalone ground floor, registered contract, negotiable, urgent!!'
         WHEN 5 THEN 'villa in compound, private garden, lagoon, super lux finish https://x.example/a'
         WHEN 6 THEN 'كمبوند حمام سباحة تكييف قسط استلام فوري'
         WHEN 7 THEN 'Semi finished, needs renovation, not registered, 12 years old'
         WHEN 8 THEN 'small flat near mall, quiet, furnished, ac, wifi'
         WHEN 9 THEN 'SODIC resort chalet, ready to move, prime location'
         WHEN 10 THEN '' ELSE NULL END)
       || (CASE (k * 7) % 29
         WHEN 1 THEN ' Balcony with terrace, natural gas.'
         WHEN 2 THEN ' بلكونة و غاز طبيعي و مخزن'
         WHEN 3 THEN ' Storage, gym and generator.'
         WHEN 4 THEN ' Near ring road highway, main street, corner.'
         WHEN 5 THEN ' على الشارع زاوية محور'
         WHEN 6 THEN ' Cash only, below market, opportunity!'
         WHEN 7 THEN ' كاش فقط لقطة عاجل'
         WHEN 8 THEN ' North facing, street view.'
         WHEN 9 THEN ' South facing, west breeze'
         WHEN 10 THEN ' شمالي شرقي'
         WHEN 11 THEN ' جنوبي غربي اطلالة شارع'
         WHEN 12 THEN ' Master bedroom and dressing room.'
         WHEN 13 THEN ' غرفة سائق غرفة ملابس'
         WHEN 14 THEN ' Driver room, nanny room'
         WHEN 15 THEN ' مربية ماستر'
         WHEN 16 THEN ' Close to New Cairo, 5th settlement'
         WHEN 17 THEN ' Road to Sheikh Zayed and 6th October'
         WHEN 18 THEN ' Sahel, north coast summer'
         WHEN 19 THEN ' Bare shell, unfinished'
         WHEN 20 THEN ' Security cameras, school, hospital and mosque'
         WHEN 21 THEN ' جيم مولد كاميرات مسجد مدرسة مستشفى'
         WHEN 22 THEN ' First use, never lived, top floor 9' ELSE '' END) AS description,
       od AS listed_at
FROM priced
"""

SCORED_SQL = """
SELECT o.o_orderkey AS listing_id,
       o.o_totalprice AS ask,
       o.o_totalprice * (30 + o.o_orderkey % 230) / 100 AS pred,
       o.o_totalprice * (30 + o.o_orderkey % 230) / 100 * (95 - o.o_orderkey % 25) / 100 AS lo,
       o.o_totalprice * (30 + o.o_orderkey % 230) / 100 * (105 + o.o_orderkey % 25) / 100 AS hi,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Villa' WHEN 2 THEN 'Duplex'
            WHEN 3 THEN 'Penthouse' ELSE 'Chalet' END AS type_clean,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'New Cairo' WHEN 1 THEN 'Sheikh Zayed' WHEN 2 THEN 'Ain Sokhna'
            WHEN 3 THEN 'North Coast' WHEN 4 THEN 'Maadi' WHEN 5 THEN '5th Settlement' ELSE 'Unknown' END AS city,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS in_compound,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(30 + (o.o_orderkey * 37) % 420 AS DOUBLE) END AS size_sqm,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'premium' ELSE 'unknown' END AS developer_level,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 'yes' ELSE 'no' END AS has_pool,
       CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE CAST(o.o_orderkey % 16 AS DOUBLE) END AS installment_years,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderkey % 45 AS DOUBLE) / 100 END AS down_payment_ratio,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'Cash' ELSE 'Installments' END AS payment_type
FROM orders o
"""

# Five per-fold log predictions for the interval operator (M4).
FOLD_PREDS_SQL = """
SELECT listing_id, ask, type_clean,
       ln(1 + pred) + CAST((listing_id * 1) % 7 AS DOUBLE) / 100 AS p1,
       ln(1 + pred) + CAST((listing_id * 2) % 7 AS DOUBLE) / 100 AS p2,
       ln(1 + pred) + CAST((listing_id * 3) % 7 AS DOUBLE) / 100 AS p3,
       ln(1 + pred) + CAST((listing_id * 4) % 7 AS DOUBLE) / 100 AS p4,
       ln(1 + pred) + CAST((listing_id * 5) % 7 AS DOUBLE) / 100 AS p5
FROM scored
"""


def _register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing table (text columns) derived from orders/customer/nation/region."""
    _register(spark, sf_dir, ["orders", "customer", "nation", "region"])
    return spark.sql(LISTINGS_SQL)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks, predictions and listing attributes, one row per order."""
    _register(spark, sf_dir, ["orders"])
    return spark.sql(SCORED_SQL)


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fold predictions per scored row (log scale)."""
    scored(spark, sf_dir).createOrReplaceTempView("scored")
    return spark.sql(FOLD_PREDS_SQL)

"""J1 clean_listings: raw listing text -> typed clean table, quarantine, quality row; new asks with frozen counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propval.operators import clean as C
from propval.operators import stats as S
from propval.plans.materialize import materialize, materialize_observed

CLEAN_COLUMNS = [
    "listing_id", "listing_type", "price_egp", "log_price", "size_sqm", "bedrooms_n", "bathrooms_n",
    "has_maid", "is_installment", "is_cash", "down_payment_ratio", "log_down_payment", "type_clean",
    "desc_clean", "room_ratio", "compound", "city", "governorate", "install_years", "log_comp_size",
    "finish_ord", "view_score", "market_tier", "area_market_zone", "area_market_zone_ord",
    "is_compound", "compound_tier", "standalone_premium", "compound_premium", "log_size_sqm",
    "size_sqm_inv", "size_per_bedroom", "size_x_finish", "size_bucket", "city_comp",
    "governorate_comp",
]


def parse_rows(df: DataFrame) -> DataFrame:
    """Per-row parsers C3-C24 (no cross-row statistics)."""
    df = C.add_size(df)
    df = C.add_rooms(df)
    df = C.add_payment_flags(df)
    df = C.add_down_payment(df)
    df = C.add_type_and_text(df)
    df = C.add_room_ratio(df)
    df = C.add_location(df)
    df = C.add_install_years(df)
    df = C.add_finish_view(df)
    df = C.add_market_tier(df)
    df = C.add_market_zone(df)
    df = C.add_compound_features(df)
    df = C.add_size_features(df)
    return C.fix_mislabeled_types(df)


def parse_all(raw: DataFrame, materialized: bool = True) -> DataFrame:
    """Every row through the per-row parsers, written once; ``price_egp`` is NULL where the price does not parse."""
    df = parse_rows(C.add_price(C.add_listing_type(raw), drop_invalid=False))
    return materialize(df, "parsed_listings") if materialized else df


def trim_and_count(parsed: DataFrame, trim_by=(), quantile_method: str = "exact") -> DataFrame:
    """C1-C24 + G1-G2: priced, trimmed, parsed rows with the compound frequency."""
    df = S.trim_price(parsed.where(F.col("price_egp").isNotNull()), by=trim_by, method=quantile_method)
    return S.add_group_count(df, "compound", "log_comp_size")


def parse_listings(raw: DataFrame, trim_by=(), quantile_method: str = "exact",
                   materialized: bool = True) -> DataFrame:
    """Raw rows to ``trim_and_count``.

    Every per-row parser is independent of the trim, so rows are parsed once
    and written (``materialized``); the trim bounds, compound counts and
    fences then read that columnar table (one price column for the bounds)
    instead of re-running the text parsers per statistic.
    """
    return trim_and_count(parse_all(raw, materialized), trim_by, quantile_method)


def repair_types(df: DataFrame, quantile_method: str = "exact") -> DataFrame:
    """G3/G4 + C28 (before the type filter)."""
    df = S.relabel_outliers(df, method=quantile_method)
    return C.add_interaction_keys(df)


def _supported(repaired: DataFrame) -> DataFrame:
    df = C.filter_supported_types(repaired)
    return df.select(*[c for c in CLEAN_COLUMNS if c in df.columns])


def clean_listings(raw: DataFrame, trim_by=(), quantile_method: str = "exact",
                   keep_all_columns: bool = False, materialized: bool = True) -> DataFrame:
    """The whole cleaning job. Unsupported types are dropped (see ``CleanRun.quarantine``)."""
    df = repair_types(parse_listings(raw, trim_by, quantile_method, materialized), quantile_method)
    return C.filter_supported_types(df) if keep_all_columns else _supported(df)


@dataclass
class CleanRun:
    """One run of J1: the rows are parsed once and repaired once; every output reads those two tables."""

    parsed: DataFrame           # every row, typed
    repaired: DataFrame         # priced, trimmed and relabelled rows, before the type filter
    compound_counts: DataFrame  # (compound, log_comp_size): frozen for the asks that come later
    parsed_metrics: dict        # what the two writing jobs observed
    repaired_metrics: dict

    @property
    def clean(self) -> DataFrame:
        """C30's rows."""
        return _supported(self.repaired)

    @property
    def quarantine(self) -> DataFrame:
        """Rows that reach the type filter with an unsupported type."""
        return C.quarantine_unsupported(self.repaired).select("listing_id", "type_clean", "reject_reason")

    @property
    def quality(self) -> DataFrame:
        """One row with rows in, parse failures per column and dropped types, observed by the jobs that wrote the tables."""
        row = self.parsed_metrics | self.repaired_metrics
        return self.parsed.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} long" for c in row))


def _counted(**conditions) -> list:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def _parsed_metrics() -> list:
    return _counted(rows_in=F.lit(True), price_unparsed=F.col("price_egp").isNull())


def _repaired_metrics() -> list:
    return _counted(
        rows_trimmed=F.lit(True), size_unparsed=F.col("size_sqm").isNull(), bedrooms_unparsed=F.col("bedrooms_n").isNull(),
        bathrooms_unparsed=F.col("bathrooms_n").isNull(), types_dropped=C.normalized_type_col("type_clean").isNull(),
        fence_relabelled=F.col("fence_relabelled") == 1)


def run_clean(raw: DataFrame, trim_by=(), quantile_method: str = "exact") -> CleanRun:
    """J1 once: clean rows, quarantine, quality row and the statistics that new asks are read with."""
    parsed, parsed_metrics = materialize_observed(parse_all(raw, materialized=False), "parsed_listings", _parsed_metrics())
    counted = trim_and_count(parsed, trim_by, quantile_method)
    repaired, repaired_metrics = materialize_observed(repair_types(counted, quantile_method), "repaired_listings", _repaired_metrics())
    counts = (repaired.where(F.col("compound").isNotNull()).groupBy("compound")
              .agg(F.log1p(F.count(F.lit(1))).alias("log_comp_size")))
    return CleanRun(parsed, repaired, materialize(counts, "compound_counts"), parsed_metrics, repaired_metrics)


def clean_asks(raw: DataFrame, compound_counts: DataFrame) -> DataFrame:
    """New asks by the same parsers and a fitted run's compound counts.

    No ask is trimmed or relabelled, whatever else arrives with it. One without a price or with an unsupported type
    is left out; a compound that the fitted run has not met has a NULL count, which the frozen median fills later.
    """
    df = parse_all(raw).where(F.col("price_egp").isNotNull()).withColumn("log_price", F.log1p("price_egp"))
    return _supported(C.add_interaction_keys(df.join(S.broadcast_if_small(compound_counts), "compound", "left")))


def sample_listings(df: DataFrame, n: int, seed: int = 42, order_col: str | None = None,
                    id_col: str = "listing_id") -> DataFrame:
    """A deterministic sample of n rows (seeded hash order, or ``order_col``); top-k per partition,
    so only n rows per task reach the final merge."""
    key = F.col(order_col) if order_col else F.xxhash64(F.col(id_col), F.lit(seed))
    return df.orderBy(key, F.col(id_col)).limit(n)

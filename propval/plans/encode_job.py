"""J3 fit_encodings / apply_encodings over the clean listing table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.functions import rules as R
from propval.operators import clean as C
from propval.operators import encode as E

TE_COLUMNS = [c for c, _ in R.TE_SMOOTHING]


def oracle_split() -> Column:
    """Deterministic split used by oracle-checked queries: every fifth id is test."""
    return (F.col("listing_id") % 5) == 0


def oracle_fold() -> Column:
    return (F.col("listing_id") / 5).cast("bigint") % 5


@dataclass
class Encodings:
    te_oof: DataFrame
    te_map: DataFrame
    te_gm: DataFrame
    pps_oof: DataFrame
    pps_map: DataFrame
    pps_gm: DataFrame
    rarity: DataFrame


def prepare(clean: DataFrame, split_col: Column | None = None, fold_col: Column | None = None) -> DataFrame:
    """Clean table + combo keys + split + folds."""
    df = C.add_encoding_keys(clean)
    df = E.add_split(df, split_col=split_col)
    return E.add_folds(df, fold_col=fold_col)


def fit(prepared: DataFrame, method: str = "exact") -> Encodings:
    train = prepared.where(~F.col("is_test"))
    te_oof, te_map, te_gm = E.fit_target_encodings(train, R.TE_SMOOTHING)
    pps_oof, pps_map, pps_gm = E.fit_price_per_sqm(train, method=method)
    rarity = E.fit_rarity(train)
    return Encodings(te_oof, te_map, te_gm, pps_oof, pps_map, pps_gm, rarity)


def encode_train(prepared: DataFrame, enc: Encodings) -> DataFrame:
    """Training rows with out-of-fold encodings."""
    train = prepared.where(~F.col("is_test"))
    df = E.apply_target_encodings(train, enc.te_oof, enc.te_gm, TE_COLUMNS, fold="fold")
    return E.apply_price_per_sqm(df, enc.pps_oof, enc.pps_gm, fold="fold")


def encode_new(df: DataFrame, enc: Encodings) -> DataFrame:
    """Any rows (test or new listings) with the frozen full-train encodings."""
    df = E.apply_target_encodings(df, enc.te_map, enc.te_gm, TE_COLUMNS)
    return E.apply_price_per_sqm(df, enc.pps_map, enc.pps_gm)

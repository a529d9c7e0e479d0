"""Fitted encodings and statistics.

* Split / folds (G5, G6): deterministic hash of a stable id, or a caller column.
* Out-of-fold smoothed target encoding (G7, G8): ONE aggregation over all
  encoded columns (unpivoted to (enc_col, key, fold, y)), per-key totals by a
  window over that small table, "total minus own fold" for the out-of-fold
  value. Map-side combine makes hot keys harmless.
* Out-of-fold median (G9): values are counted once per (key, fold); the counts,
  not the rows, go to the n-1 folds they train and add up there, and the exact
  quantile works on these counts.
* Fitted tables are small DataFrames applied by left joins; AQE broadcasts
  them when their measured size is small and splits skewed joins otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from propval.functions import rules as R
from propval.operators.stats import MAX_BROADCAST_BYTES, attach_scalars, broadcast_if_small, estimated_bytes, quantiles, quantiles_of_counts
from propval.plans.materialize import materialize


# ---------------------------------------------------------------------------
# G5 / G6 split and folds
# ---------------------------------------------------------------------------

def hash_bucket(id_col: str, n: int, seed: int = R.SEED) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n))


def add_split(df: DataFrame, id_col: str = "listing_id", test_share: float = R.TEST_SHARE,
              seed: int = R.SEED, split_col: Column | None = None, out: str = "is_test") -> DataFrame:
    """G5: 'is_test' from a seeded hash of the id (or a caller-supplied boolean column)."""
    flag = split_col if split_col is not None else hash_bucket(id_col, 100, seed) < int(round(test_share * 100))
    return df.withColumn(out, flag.cast("boolean"))


def add_folds(df: DataFrame, id_col: str = "listing_id", n_folds: int = R.N_FOLDS, seed: int = R.SEED,
              fold_col: Column | None = None, out: str = "fold") -> DataFrame:
    """Fold number in [0, n) from a seeded hash (or a caller-supplied column)."""
    fold = fold_col if fold_col is not None else hash_bucket(id_col, n_folds, seed + 1)
    return df.withColumn(out, fold.cast("int"))


# ---------------------------------------------------------------------------
# G7 / G8 out-of-fold target encodings
# ---------------------------------------------------------------------------

def _unpivot(df: DataFrame, columns: Sequence[str], extra: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("enc_col"), F.col(c).cast("string").alias("key")) for c in columns])
    return df.select(*extra, F.explode(pairs).alias("_p")).select(*extra, "_p.enc_col", "_p.key")


def fit_target_encodings(train: DataFrame, specs: Sequence[tuple[str, int]], target: str = "log_price",
                         fold: str = "fold") -> tuple[DataFrame, DataFrame, DataFrame]:
    """G7/G8 fit. Returns (oof_table, full_table, gm_table).

    oof_table : enc_col, key, fold, value  (encoding seen by rows of that fold)
    full_table: enc_col, key, value        (encoding for new rows; the artefact)
    gm_table  : one row with the global mean ``gm``
    """
    ks = F.create_map(*[x for c, k in specs for x in (F.lit(c), F.lit(float(k)))])
    gm = train.agg(F.avg(target).alias("gm"))
    long = _unpivot(train.where(F.col(target).isNotNull()), [c for c, _ in specs], [fold, target])
    per_fold = (long.where(F.col("key").isNotNull())
                .groupBy("enc_col", "key", fold)
                .agg(F.sum(target).alias("_s"), F.count(F.lit(1)).alias("_n")))
    totals = per_fold.groupBy("enc_col", "key").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    g = F.col("gm")
    k = ks[F.col("enc_col")]
    full = (attach_scalars(totals, gm)
            .select("enc_col", "key", ((F.col("_ts") + k * g) / (F.col("_tn") + k)).alias("value")))
    # a training row's key always occurs in its own fold, so (key, fold) pairs come from per_fold;
    # per-key totals are a window over that aggregate (<= n_folds rows per key, so no skew)
    w = Window.partitionBy("enc_col", "key")
    oof = (per_fold.withColumn("_ts", F.sum("_s").over(w)).withColumn("_tn", F.sum("_n").over(w))
           .transform(lambda t: attach_scalars(t, gm))
           .select("enc_col", "key", fold,
                   ((F.col("_ts") - F.col("_s") + k * g) / (F.col("_tn") - F.col("_n") + k)).alias("value")))
    return oof, full, gm


def apply_target_encodings(df: DataFrame, table: DataFrame, gm: DataFrame, columns: Sequence[str],
                           fold: str | None = None, suffix: str = "_te",
                           max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """G7 (with ``fold``: out-of-fold values) / G10 (without: frozen full-train values).

    Missing keys fall back to the global mean. When all columns' tables together pass the size check, each is
    broadcast. Otherwise the rows are written with a row number, unpivoted to (row, enc_col, key), joined once and
    brought back to their row: three narrow shuffles, and the same values, whatever ids repeat.
    """
    extra = [fold] if fold else []
    df = attach_scalars(df, gm.select(F.col("gm").alias("_gm")))
    parts = [table.where(F.col("enc_col") == c).select(
        F.col("key").alias(f"_k_{c}"), *[F.col(x).alias(f"_f_{c}") for x in extra], F.col("value").alias(f"_v_{c}")) for c in columns]
    if sum(estimated_bytes(t) for t in parts) <= max_broadcast_bytes:
        for c, t in zip(columns, parts):
            cond = df[c].cast("string") == t[f"_k_{c}"]
            if fold:
                cond = cond & (df[fold] == t[f"_f_{c}"])
            df = df.join(F.broadcast(t), cond, "left").drop(f"_k_{c}", f"_f_{c}")
    else:
        df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows_to_encode")
        long = _unpivot(df, columns, ["_row", *extra])
        hit = long.join(table.where(F.col("enc_col").isin(*columns)), ["enc_col", "key", *extra])
        wide = hit.groupBy("_row").agg(*[F.first(F.when(F.col("enc_col") == c, F.col("value")), ignorenulls=True).alias(f"_v_{c}") for c in columns])
        df = df.join(wide, "_row", "left").drop("_row")
    for c in columns:
        df = df.withColumn(c + suffix, F.coalesce(F.col(f"_v_{c}"), F.col("_gm"))).drop(f"_v_{c}")
    return df.drop("_gm")


# ---------------------------------------------------------------------------
# G9 out-of-fold median log price per sqm
# ---------------------------------------------------------------------------

def lpps_col(log_price: str = "log_price", size: str = "size_sqm") -> Column:
    s = F.col(size)
    return F.col(log_price) - F.log1p(F.when(s.isNotNull(), F.greatest(s, F.lit(1.0))))


def other_fold_counts(df: DataFrame, keys: Sequence[str], value: str, fold: str, n_folds: int,
                      wanted: Sequence[int] | None = None) -> DataFrame:
    """(keys, _target, _v, _c): how often each value (NULL included) occurs outside of fold ``_target`` (all, or the ``wanted``)."""
    own = df.groupBy(*keys, fold, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    targets = F.filter(F.array(*map(F.lit, range(n_folds) if wanted is None else wanted)), lambda f: f != F.col(fold))
    return (own.select(*keys, F.explode(targets).alias("_target"), "_v", "_c")
            .groupBy(*keys, "_target", "_v").agg(F.sum("_c").alias("_c")))


def fit_price_per_sqm(train: DataFrame, keys: Sequence[str] = ("city", "type_clean"), fold: str = "fold",
                      n_folds: int = R.N_FOLDS, method: str = "exact") -> tuple[DataFrame, DataFrame, DataFrame]:
    """G9 fit. Returns (oof_table: keys+fold+lpps+present, pps_map: keys+lpps, pps_gm: one row).

    A key seen in the training folds keeps its median even when that median is
    NULL (all sizes missing); only unseen keys fall back to the global median.
    """
    keys = list(keys)
    pts = train.select(*keys, fold, lpps_col().alias("lpps"))
    pps_gm = quantiles(pts, "lpps", [0.5], ["pps_gm"], method=method)
    seen = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    med = quantiles(pts, "lpps", [0.5], ["lpps"], by=keys, method=method)
    pps_map = seen.join(med, keys, "left").select(*keys, "lpps")
    counts = other_fold_counts(pts, [*keys], "lpps", fold, n_folds)
    seen_f = counts.groupBy(*keys, "_target").agg(F.sum("_c").alias("_n"))
    med_f = quantiles_of_counts(counts.where(F.col("_v").isNotNull()), [0.5], ["lpps"], by=keys + ["_target"])
    oof = (seen_f.join(med_f, keys + ["_target"], "left")
           .select(*keys, F.col("_target").alias(fold), "lpps"))
    return oof, pps_map, pps_gm


def apply_price_per_sqm(df: DataFrame, table: DataFrame, pps_gm: DataFrame,
                        keys: Sequence[str] = ("city", "type_clean"), fold: str | None = None,
                        out: str = "price_per_sqm_estimate") -> DataFrame:
    """G9 apply (OOF with ``fold``) / G10 apply (frozen map): seen key -> its median, else the global median."""
    keys = list(keys) + ([fold] if fold else [])
    t = broadcast_if_small(table.select(*keys, F.col("lpps").alias("_lpps"), F.lit(True).alias("_seen")))
    df = attach_scalars(df.join(t, keys, "left"), pps_gm.select(F.col("pps_gm").alias("_pgm")))
    return df.withColumn(out, F.when(F.col("_seen").isNotNull(), F.col("_lpps")).otherwise(F.col("_pgm"))) \
             .drop("_lpps", "_seen", "_pgm")


# ---------------------------------------------------------------------------
# G11 rarity, G12 impute + clip, G13 column selection
# ---------------------------------------------------------------------------

def fit_rarity(train: DataFrame, keys: Sequence[str] = ("city", "type_clean")) -> DataFrame:
    """1 / (rows per key + 1)."""
    return train.groupBy(*keys).agg((F.lit(1.0) / (F.count(F.lit(1)) + 1.0)).alias("rarity"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(F.explode(pairs).alias("_p")).select("_p.feature", "_p.value")


def fit_impute_clip(df: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99,
                    method: str = "exact") -> DataFrame:
    """G12 fit: per-feature median, then p01/p99 of the imputed values. One row per feature.

    Features are unpivoted so every column's quantiles come from one grouped
    (distributed) quantile job instead of one job per column.
    """
    long = _long(df, columns)
    med = quantiles(long, "value", [0.5], ["median"], by=["feature"], method=method)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    med = materialize(names.join(med, "feature", "left"), "medians")  # written: the passes below would each find them anew
    imputed = long.join(F.broadcast(med), "feature").select(
        "feature", F.coalesce(F.col("value"), F.col("median")).alias("value"))
    q = quantiles(imputed, "value", [lo, hi], ["clip_lo", "clip_hi"], by=["feature"], method=method)
    return med.join(q, "feature", "left")


def apply_impute_clip(df: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """G12 apply: fill with the frozen median, clip to the frozen [p01, p99] (NULL bound = no bound)."""
    return impute_clip(df, {r["feature"]: r for r in table.collect()}, columns)  # one row per feature: bounded by the column count


def impute_clip(df: DataFrame, rows: Mapping[str, Row], columns: Sequence[str]) -> DataFrame:
    """``apply_impute_clip`` from the fitted rows (median, clip_lo, clip_hi) by feature."""
    out = []
    for c in columns:
        r = rows.get(c)
        v = F.col(c).cast("double")
        if r is None:
            out.append(v.alias(c))
            continue
        if r["median"] is not None:
            v = F.coalesce(v, F.lit(r["median"]))
        if r["clip_lo"] is not None:
            v = F.when(v.isNotNull(), F.greatest(v, F.lit(r["clip_lo"])))
        if r["clip_hi"] is not None:
            v = F.when(v.isNotNull(), F.least(v, F.lit(r["clip_hi"])))
        out.append(v.alias(c))
    keep = [c for c in df.columns if c not in set(columns)]
    return df.select(*keep, *out)


def select_present(df: DataFrame, wanted: Sequence[str], required: Sequence[str] = ()) -> list[str]:
    """The wanted columns that exist; missing required ones raise (first five listed)."""
    have = set(df.columns)
    missing = sorted(set(required) - have)
    if missing:
        raise ValueError(f"these columns are required but not there: {', '.join(missing[:5])}" + (" and more" if len(missing) > 5 else ""))
    return [c for c in wanted if c in have]


def aligned_counts(df: DataFrame, wanted: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """G13 over the rows: (position, feature, n_rows, n_present, n_nan) of the wanted columns that exist, one aggregate."""
    present = select_present(df, wanted, required)
    values = {c: F.col(c).cast("double") for c in present}
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(v).alias(f"_p{i}") for i, v in enumerate(values.values())],
                    *[F.count_if(F.isnan(v)).alias(f"_x{i}") for i, v in enumerate(values.values())])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col("_n").alias("n_rows"),
                     F.col(f"_p{i}").alias("n_present"), F.col(f"_x{i}").alias("n_nan")) for i, c in enumerate(present)]
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")

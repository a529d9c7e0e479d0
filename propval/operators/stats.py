"""Distributed statistics used by cleaning and encoding (G1-G4, quantiles).

Quantiles are exact with linear interpolation (pandas / DuckDB ``quantile_cont``) and take one path at every size:
radix selection. A first pass counts rows per group and coarse value cell, a second one refines the few cells that
hold a wanted rank and more than one value, a third one counts the distinct values left in those. Counts combine on the map side, raw rows
are never sorted or shuffled, and a cell table has a bounded number of rows per group, whatever the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propval.functions import rules as R
from propval.plans.materialize import materialize

# Value cells of the two counting passes: this many per power of two.
COARSE_CELLS = 1 << 8
FINE_CELLS = 1 << 28


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row statistics table to every row.

    A broadcast hash join on a constant key: the broadcast side is a single
    aggregate row, so no pairs are generated and the big side is not shuffled.
    """
    key = "_scalar_key"
    return (df.withColumn(key, F.lit(0))
              .join(F.broadcast(one_row.withColumn(key, F.lit(0))), key, "left").drop(key))


# Fitted tables (encodings, medians, rarity) at most this large are broadcast explicitly.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a lookup table only when its planning-time size proves it small.

    Fitted tables are written to parquet, so their estimate is the file size;
    anything larger (or with an unknowable estimate) is left to AQE, which
    broadcasts on measured size or splits skewed partitions.
    """
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (an upper bound; planning only, no job)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def value_slice(value: Column, per_octave: int = COARSE_CELLS) -> Column:
    """Number of the fixed value range that holds ``value``; never falls as the value grows.

    Each power of two has ``per_octave`` ranges of equal width; negative values mirror the positive ones. A
    logarithm rounded up to the next power gives the last range below it, so order holds there as well.
    """
    v = value.cast("double")
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), octave) - 1.0) * per_octave)
    rank = (octave + 1100) * per_octave + inside
    top = F.lit(3000 * per_octave).cast("long")
    finite = F.when(size < 1e-300, F.lit(1).cast("long")).otherwise(rank.cast("long"))
    slice_ = F.when(F.isnan(v), top + 1).when(size == float("inf"), top).when(v == 0, F.lit(0).cast("long")).otherwise(finite)
    return F.when(v < 0, -slice_).otherwise(slice_)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
              by: Sequence[str] = (), method: str = "exact", accuracy: int = 1_000_000) -> DataFrame:
    """Per-group quantiles of ``value`` (NULL values ignored, NULL group keys are groups).

    Returns one row per group (one row if ``by`` is empty) with a column per name. ``method``: 'exact' (default)
    or 'approx' (percentile_approx, returns actual elements).
    """
    by = list(by)
    probs = [float(p) for p in probs]
    src = df.where(F.col(value).isNotNull())
    if method == "approx":
        out = src.groupBy(*by).agg(F.percentile_approx(F.col(value), probs, accuracy).alias("_q"))
        return out.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    rows = src.select(*by, F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_c"))
    return _radix_select(rows, probs, names, by)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``quantiles`` from a table of values ``_v`` and their counts ``_c`` per group; written once for all passes."""
    rows = counts.select(*by, F.col("_v").cast("double").alias("_v"), F.col("_c").cast("long").alias("_c"))
    return _radix_select(materialize(rows, "value_counts"), probs, names, list(by))


def _ranks(probs: Sequence[float]) -> list[Column]:
    """The ranks (from 0, of _n rows) that the quantiles interpolate between."""
    return [f((F.col("_n") - 1) * F.lit(p)) for p in probs for f in (F.floor, F.ceil)]


def _holding(cells: DataFrame, within: Sequence[str], order: str, probs: Sequence[float]) -> DataFrame:
    """Cells (rows ``_s``) that hold a wanted rank, ``_below`` raised by the rows of the cells before them."""
    before = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    before = before.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_s").over(before), F.lit(0)))
    hit = F.lit(False)
    for r in _ranks(probs):
        hit = hit | ((F.col("_below") <= r) & (r < F.col("_below") + F.col("_s")))
    return cells.where(hit)


def _inside(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows in the given cells, with the cell's ``_below`` and the group's ``_n``.

    The cells are written, so their size is known: two for each group and wanted rank at most.
    """
    right = broadcast_if_small(cells.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_below", "_n"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(right[f"_r{i}"])
    return rows.join(right, on).drop(*[f"_r{i}" for i in range(len(keys))])


def _radix_select(rows: DataFrame, probs: Sequence[float], names: Sequence[str], by: Sequence[str]) -> DataFrame:
    rows = rows.withColumn("_c1", value_slice(F.col("_v"), COARSE_CELLS))
    extent = [F.min("_v").alias("_least"), F.max("_v").alias("_most")]
    coarse = rows.groupBy(*by, "_c1").agg(F.sum("_c").alias("_s"), *extent)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    coarse = coarse.withColumn("_n", F.sum("_s").over(whole)).withColumn("_below", F.lit(0).cast("long"))
    coarse = materialize(_holding(coarse, by, "_c1", probs), "quantile_cells")
    # a cell with one distinct value is settled; its rows, often most of a column's, go through no further pass
    one_value = F.col("_least").eqNullSafe(F.col("_most"))

    def settled(cells: DataFrame) -> DataFrame:
        return cells.where(one_value).select(*by, (F.col("_least") + F.lit(0.0)).alias("_v"), "_s", "_n", "_below")

    one, two = [*by, "_c1"], [*by, "_c1", "_c2"]
    # finer cells are computed for the rows of the open coarse cells alone
    open_rows = _inside(rows, coarse.where(~one_value), one).withColumn("_c2", value_slice(F.col("_v"), FINE_CELLS))
    fine = open_rows.groupBy(*two).agg(F.sum("_c").alias("_s"), F.max("_n").alias("_n"), F.max("_below").alias("_below"), *extent)
    fine = materialize(_holding(fine, one, "_c2", probs), "quantile_cells")
    last = _inside(open_rows.drop("_n", "_below"), fine.where(~one_value), two).groupBy(*two, "_v").agg(
        F.sum("_c").alias("_s"), F.max("_n").alias("_n"), F.max("_below").alias("_below"))
    last = _holding(last, two, "_v", probs).select(*by, "_v", "_s", "_n", "_below")
    placed = settled(coarse).unionByName(settled(fine)).unionByName(last)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_s")), F.col("_v")))

    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
    picked = placed.groupBy(*by).agg(*aggs)

    def between(i: int, p: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(F.floor(h) == F.ceil(h), lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)

    return picked.select(*by, *[between(i, p).alias(n) for i, (p, n) in enumerate(zip(probs, names))])


# ---------------------------------------------------------------------------
# G1: global price trim
# ---------------------------------------------------------------------------

def price_bounds(df: DataFrame, price: str = "price_egp", lo: float = R.PRICE_TRIM[0],
                 hi: float = R.PRICE_TRIM[1], by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """q_lo / q_hi of price (one row, or one per ``by`` group)."""
    return quantiles(df, price, [lo, hi], ["price_q_lo", "price_q_hi"], by=by, method=method)


def trim_price(df: DataFrame, price: str = "price_egp", lo: float = R.PRICE_TRIM[0],
               hi: float = R.PRICE_TRIM[1], by: Sequence[str] = (), method: str = "exact",
               bounds: DataFrame | None = None) -> DataFrame:
    """G1: keep rows with price in [q_lo, q_hi] (inclusive) and add ``log_price``.

    ``by`` (e.g. ``['listing_type']``) trims rent and sale separately; the
    default mixes them like the original pipeline.
    """
    b = bounds if bounds is not None else price_bounds(df, price, lo, hi, by, method)
    joined = attach_scalars(df, b) if not by else df.join(b, list(by), "left")
    p = F.col(price)
    return (joined.where((p >= F.col("price_q_lo")) & (p <= F.col("price_q_hi")))
                  .drop("price_q_lo", "price_q_hi")
                  .withColumn("log_price", F.log1p(p)))


# ---------------------------------------------------------------------------
# Compound frequency
# ---------------------------------------------------------------------------

def add_group_count(df: DataFrame, key: str = "compound", out: str = "log_comp_size",
                    log: bool = True) -> DataFrame:
    """log1p(rows per key), joined back.

    The count is a map-side-combined aggregate (one row per key). It is
    written first, so that its size is known before the join is planned: a
    small table is broadcast and the wide rows stay where they are, a large
    one is a sort-merge join whose hot keys AQE splits.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out_col = F.log1p(F.col("_n")) if log else F.col("_n")
    counts = materialize(counts.select(key, out_col.alias(out)), "group_counts")
    return df.join(broadcast_if_small(counts), key, "left")


# ---------------------------------------------------------------------------
# IQR fence per city x size bin and outlier relabel
# ---------------------------------------------------------------------------

def fence_bin_col(size: str = "size_sqm") -> Column:
    s = F.col(size)
    b = R.FENCE_BINS
    expr = None
    for i, label in enumerate(R.FENCE_BIN_LABELS):
        cond = (s > b[i]) & (s <= b[i + 1])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def ppsm_col(price: str = "price_egp", size: str = "size_sqm") -> Column:
    s = F.col(size)
    return F.col(price) / F.when(s.isNotNull(), F.greatest(s, F.lit(1.0)))


def iqr_fences(df: DataFrame, type_col: str = "type_clean", city: str = "city",
               price: str = "price_egp", size: str = "size_sqm", method: str = "exact") -> DataFrame:
    """Per (city, size bin) fence = q75 + 3 IQR of price per sqm among apartments.

    Groups need >= 10 priced rows; no fence at all when there are fewer than
    100 apartments (expressed as a join with a 1-row count, no driver branch).
    """
    apt = df.where(F.col(type_col) == "Apartment")
    n_apt = apt.agg(F.count(F.lit(1)).alias("_n_apt"))
    pts = apt.select(city, fence_bin_col(size).alias("fence_bin"),
                     ppsm_col(price, size).alias("ppsm")).where(
        F.col(city).isNotNull() & F.col("fence_bin").isNotNull())
    q = quantiles(pts, "ppsm", [0.25, 0.75], ["q25", "q75"], by=[city, "fence_bin"], method=method)
    cnt = pts.groupBy(city, "fence_bin").agg(F.count("ppsm").alias("n"))
    stats = q.join(cnt, [city, "fence_bin"])
    stats = (stats.withColumn("iqr", F.col("q75") - F.col("q25"))
                  .withColumn("upper_fence", F.col("q75") + F.lit(R.FENCE_IQR_MULT) * F.col("iqr"))
                  .where(F.col("n") >= R.FENCE_MIN_GROUP))
    return (attach_scalars(stats, n_apt).where(F.col("_n_apt") >= R.FENCE_MIN_APARTMENTS)
                 .drop("_n_apt"))


def relabel_outliers(df: DataFrame, fences: DataFrame | None = None, type_col: str = "type_clean",
                     city: str = "city", price: str = "price_egp", size: str = "size_sqm",
                     desc: str = "desc_clean", method: str = "exact") -> DataFrame:
    """Apartments priced above their fence and large (or penthouse-worded) are relabelled."""
    if fences is None:
        fences = iqr_fences(df, type_col, city, price, size, method)
    f = materialize(fences, "fences").select(F.col(city).alias("_f_city"), F.col("fence_bin").alias("_f_bin"),
                      F.col("upper_fence").alias("_fence"))
    with_bin = df.withColumn("_bin", fence_bin_col(size))
    joined = with_bin.join(broadcast_if_small(f), (with_bin[city] == f["_f_city"]) & (with_bin["_bin"] == f["_f_bin"])
                           & (with_bin[type_col] == "Apartment"), "left")
    s = F.col(size)
    pent = F.lower(F.coalesce(F.col(desc), F.lit(""))).contains("penthouse")
    suspicious = (F.coalesce(ppsm_col(price, size) > F.col("_fence"), F.lit(False))
                  & (F.coalesce(s > 300, F.lit(False)) | pent))
    new_type = (F.when(suspicious & pent, F.lit("Penthouse"))
                .when(suspicious & (s > 350), F.lit("Villa"))
                .when(suspicious & (s > 250), F.lit("Duplex"))
                .otherwise(F.col(type_col)))
    return (joined.withColumn(type_col, new_type)
                  .withColumn("fence_relabelled", suspicious.cast("int"))
                  .drop("_bin", "_f_city", "_f_bin", "_fence"))

"""Ranks, prefix sums and exact quantiles without a one-task window.

Every ordered pass here has two levels.  Rows get a bucket that is monotone in
the sort value; bucket totals (a few rows per key) give each bucket its offset;
the ordered window then runs inside (key, bucket).  A key that holds most of
the table is thereby spread over all its buckets.  The choice of buckets only
affects balance, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6  # 2**6 buckets per key at least
MOST_LEVELS = 13
BUCKET_BYTES = 128 << 20


def source_bytes(df: DataFrame) -> int:
    """Bytes of the plan's sources whose size is known, without a job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # a source of unknown size reports the largest number


def levels_for(df: DataFrame) -> int:
    """Levels that keep a bucket of one key near BUCKET_BYTES even if the key holds
    the whole input."""
    return min(MOST_LEVELS, max(LEVELS, (source_bytes(df) // BUCKET_BYTES).bit_length()))


def _find_bucket(df: DataFrame, value: str, cuts: str, levels: int, out: str) -> DataFrame:
    """Number of cuts <= value by binary search; one small projection per level."""
    df = df.withColumn(out, F.lit(0))
    for k in range(levels - 1, -1, -1):
        step = 1 << k
        df = df.withColumn(
            out,
            F.col(out) + F.when(F.get(F.col(cuts), F.col(out) + (step - 1)) <= F.col(value), step).otherwise(0),
        )
    return df


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Join on possibly NULL keys.  ``small`` is set where the caller has bounded
    the number of keys (a chunk of candidates, folds); else AQE decides from size."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row per bucket at most
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return left.join(F.broadcast(renamed) if small else renamed, cond).drop(*[f"_k_{k}" for k in keys])


def tie_prefix(
    counts: DataFrame,
    keys: Sequence[str],
    value: str = "v",
    levels: int | None = None,
    small_keys: bool = True,
) -> DataFrame:
    """Running totals over distinct values.

    ``counts`` has one row per (keys, value) with positives ``p`` and rows
    ``n``.  The result adds, per row, ``tp``/``np``: positives and rows with a
    value at or above this one, and per key ``pos``, ``tot`` and ``var`` (population
    variance of the value over rows).
    """
    levels = levels_for(counts) if levels is None else levels
    k = 1 << levels
    # p and n are read here as well, so that every branch below needs the same
    # columns and all of them share one exchange of ``counts``
    seen = F.when((F.col("p") >= 0) & (F.col("n") > 0), F.col(value))
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(seen, [(i + 1) / k for i in range(k - 1)], 10 * k).alias("_cuts"),
    )
    if not keys:
        cuts = cuts.where(F.col("_cuts").isNotNull())
    binned = _find_bucket(_join_keys(counts, cuts, keys, small_keys), value, "_cuts", levels, "_bin")
    shift = F.col(value) - F.get("_cuts", F.lit(k // 2 - 1))
    binned = binned.select(*counts.columns, "_bin", shift.alias("_d"))
    totals = binned.groupBy(*keys, "_bin").agg(
        F.sum("p").alias("_p"),
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * F.col("_d")).alias("_s1"),
        F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("_s2"),
    )
    above = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    n_all = F.sum("_n").over(whole)
    mean = F.sum("_s1").over(whole) / n_all
    heads = totals.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp0"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_np0"),
        F.sum("_p").over(whole).alias("pos"),
        n_all.alias("tot"),
        F.greatest(F.sum("_s2").over(whole) / n_all - mean * mean, F.lit(0.0)).alias("var"),
    )
    joined = _join_keys(binned.drop("_d"), heads, [*keys, "_bin"], small_keys)
    inside = (
        Window.partitionBy(*keys, "_bin").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.select(
        *counts.columns,
        (F.col("_tp0") + F.sum("p").over(inside)).alias("tp"),
        (F.col("_np0") + F.sum("n").over(inside)).alias("np"),
        "pos",
        "tot",
        "var",
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    small_keys: bool = False,
) -> DataFrame:
    """(keys, qs ARRAY<DOUBLE>): exact quantiles with linear interpolation."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.lit(0).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    )
    return quantiles_of(tie_prefix(counts, keys, small_keys=small_keys), keys, qs)


def quantiles_of(prefix: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Quantiles read off running totals: the value covering an order statistic."""
    last = F.col("tot") - F.col("np") + F.col("n") - 1  # highest 0-based rank of this value
    first = F.col("tot") - F.col("np")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("v")))

    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("tot") - 1) * F.lit(float(q))
        aggs += [
            at(F.floor(pos)).alias(f"_lo{i}"),
            at(F.ceil(pos)).alias(f"_hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"_fr{i}"),
        ]
    wide = prefix.groupBy(*keys).agg(*aggs)
    out = [
        F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(
            F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")
        )
        for i in range(len(qs))
    ]
    return wide.select(*keys, F.array(*out).alias("qs"))


def hash_order(seed: int | str, rid: str | Column = "rid") -> Column:
    """A reproducible shuffle key: hex digest of seed and row identity."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(rid) if isinstance(rid, str) else rid))


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Column, out: str = "rn", digits: int | None = None, weight: str | None = None,
    small_keys: bool = False,
) -> DataFrame:
    """Exact 1-based row numbers per key in the order of a hex digest.

    The leading hex digits are the bucket, so a key with most rows is numbered
    by 16**digits tasks; their number follows from the size of the plan's sources.
    With ``weight`` a row takes so many numbers and gets the first of them.  ``small_keys`` is set where the caller has
    bounded the number of keys: rows then move once.
    """
    digits = max(2, -(-levels_for(df) // 4)) if digits is None else digits
    size = F.lit(1) if weight is None else F.col(weight)
    d = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, digits)).withColumn("_h", F.unhex("_h"))
    sizes = d.groupBy(*keys, "_b").agg(F.sum(size).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h")
    if weight is None:
        place = F.row_number().over(inside)
    else:
        place = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight) + 1
    # at most 16**digits offsets per key; AQE broadcasts them where that is small
    joined = _join_keys(d, heads, [*keys, "_b"], small_keys)
    return joined.withColumn(out, F.col("_off") + place).drop("_h", "_b", "_off")


def dense_codes(distinct: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """Sorted distinct values numbered from 0.  Cut points are a hash-ordered
    sample of at most 2**levels - 1 values."""
    levels = levels_for(distinct) if levels is None else levels
    k = (1 << levels) - 1
    sample = distinct.orderBy(F.xxhash64(column), column).limit(k)
    cuts = sample.agg(F.sort_array(F.collect_list(column)).alias("_cuts"))
    b = _find_bucket(distinct.crossJoin(F.broadcast(cuts)), column, "_cuts", levels, "_bin").drop("_cuts")
    sizes = b.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**levels rows
    heads = sizes.select(F.col("_bin").alias("_hb"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bin").orderBy(column)
    return b.join(F.broadcast(heads), F.col("_bin") == F.col("_hb")).select(
        column, (F.col("_off") + F.row_number().over(inside) - 1).alias("code")
    )

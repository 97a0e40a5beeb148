"""Summaries of spectra held in array columns (descending singular values, eigenvalues)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-30


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _neighbours(a: Column, f) -> Column:
    """f(a[k], a[k+1]) for consecutive elements."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), f)


def effective_rank(sv: Column, eps: Column | float = 1e-6) -> Column:
    e = F.lit(eps) if isinstance(eps, float) else eps
    return F.when(sv[0] < TINY, F.lit(0)).otherwise(F.size(F.filter(sv, lambda s: s / sv[0] > e)))


def participation_ratio(sv: Column) -> Column:
    pos = F.filter(sv, lambda s: s > TINY)
    s1, s2 = _total(pos), F.aggregate(pos, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(s2 < 1e-60, F.lit(0.0)).otherwise(s1 * s1 / s2)


def spectral_entropy(sv: Column, normalised: bool = False) -> Column:
    pos = F.filter(sv, lambda s: s > TINY)
    total = _total(pos)
    h = F.aggregate(pos, F.lit(0.0), lambda acc, s: acc - (s / total) * F.ln(s / total + TINY))
    if not normalised:
        return h
    return F.when(F.size(pos) > 1, h / F.ln(F.size(pos).cast("double"))).otherwise(F.lit(0.0))


def gap_ratio(sv: Column) -> Column:
    return F.coalesce(F.array_max(_neighbours(sv, lambda a, b: a - b)), F.lit(0.0)) / (sv[0] + TINY)


def eigen_gap(eigs: Column) -> Column:
    return F.coalesce(F.array_max(_neighbours(F.array_sort(eigs), lambda a, b: b - a)), F.lit(0.0))


def gap_position(eigs: Column) -> Column:
    """0-based position of the largest gap of the sorted values."""
    gaps = _neighbours(F.array_sort(eigs), lambda a, b: b - a)
    return (F.array_position(gaps, F.array_max(gaps)) - 1).cast("int")


def freqs_from_eigs(eigs: Column) -> Column:
    return F.sort_array(F.transform(eigs, lambda x: F.sqrt(F.abs(x))), asc=False)


def _positive(freqs: Column) -> Column:
    return F.filter(freqs, lambda f: f > 1e-10)


def freq_ratio(freqs: Column) -> Column:
    p = _positive(freqs)
    return F.when(F.size(p) >= 2, F.element_at(p, 1) / F.element_at(p, -1)).otherwise(F.lit(1.0))


def cluster_count(freqs: Column, ratio: float = 10.0) -> Column:
    return F.size(F.filter(_neighbours(_positive(freqs), lambda a, b: a / (b + TINY)), lambda r: r > ratio)) + 1


def rank_at_variance(sv: Column, share: float) -> Column:
    """Number of leading values whose squares reach the share of the total."""
    total = F.aggregate(sv, F.lit(0.0), lambda acc, s: acc + s * s)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("k"))

    def step(acc, s):
        cum = acc["cum"] + s * s
        return F.struct(cum.alias("cum"), (acc["k"] + F.when(cum / total < share, 1).otherwise(0)).alias("k"))

    return F.aggregate(sv, start, step, lambda acc: acc["k"]) + 1


def compression_ratio(rows: Column, cols: Column, r95: Column) -> Column:
    return (rows * cols) / (r95 * (rows + cols))


def condition(sv: Column) -> Column:
    return sv[0] / (F.element_at(sv, -1) + TINY)


def spread(eigs: Column) -> Column:
    return F.array_max(eigs) - F.array_min(eigs)


def min_nonzero(eigs: Column) -> Column:
    return F.coalesce(
        F.array_min(F.filter(F.transform(eigs, lambda x: F.abs(x)), lambda x: x > 1e-10)), F.lit(0.0)
    )


def kepler_deviation(eigs: Column) -> Column:
    """How far the ratio of the two largest magnitudes is from 2; 99 without a second."""
    mags = F.sort_array(F.transform(eigs, lambda x: F.abs(x)), asc=False)
    kept = F.filter(mags, lambda x: x > F.lit(1e-6) * F.element_at(mags, 1))
    return F.when(F.size(kept) >= 2, F.abs(F.element_at(kept, 1) / (F.element_at(kept, 2) + TINY) - 2.0)).otherwise(F.lit(99.0))


def diophantine_gap(df: DataFrame, key: str, freqs: str, max_order: int = 10) -> DataFrame:
    """(key, gamma): distance of frequency ratios from low-order fractions p/q,
    weighted by p + q.  Pairs are exploded and meet a fixed table of fractions."""
    spark = df.sparkSession
    pq = spark.createDataFrame(
        [(float(p), float(q)) for p in range(1, max_order + 1) for q in range(1, max_order + 1)], "p double, q double"
    )
    pos = df.select(key, _positive(F.col(freqs)).alias("f"))
    pairs = (
        pos.select(key, "f", F.posexplode("f").alias("i", "a"))
        .select(key, "i", "a", F.posexplode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("_j", "b"))
        .select(key, (F.col("a") / F.col("b")).alias("ratio"))
    )
    gap = F.abs(F.col("ratio") - F.col("p") / F.col("q"))
    best = (
        pairs.crossJoin(F.broadcast(pq))
        .where(gap > 0)
        .groupBy(key)
        .agg(F.min(gap * (F.col("p") + F.col("q"))).alias("gamma"))
    )
    return df.select(key).join(best, key, "left").select(key, F.coalesce("gamma", F.lit(0.0)).alias("gamma"))


def complexity_score(pr: Column, size: int, coupling: Column, entropy: Column, block_diagonal: Column, separable: Column) -> Column:
    norm = (pr - 1.0) / F.lit(float(size - 1))
    s = (
        F.lit(0.4) * norm
        + F.lit(0.3) * coupling
        + F.lit(0.3) * entropy
        + F.when(block_diagonal, F.lit(-0.2)).otherwise(F.lit(0.0))
        + F.when(separable, F.lit(-0.3)).otherwise(F.lit(0.0))
    )
    return F.greatest(s, F.lit(0.0))

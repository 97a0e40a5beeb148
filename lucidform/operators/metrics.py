"""Rule metrics, group summaries, information measures and linear fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidform.operators.ranking import exact_quantiles


def distribution(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(within.., keys.., n, share): counts and shares of the total; windows run over counted groups."""
    g = df.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion(df: DataFrame, rules: dict[str, Column], label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """One row per rule: tp, fp, fn, tn, precision, recall, f1, accuracy, predicted.

    All rules are counted in one pass; NULL predictions count as negative.
    """
    y = F.col(label) == 1
    aggs = [F.sum(F.when(y, 1).otherwise(0)).alias("_p"), F.count(F.lit(1)).alias("_n")]
    for i, r in enumerate(rules.values()):
        hit = F.coalesce(r, F.lit(False))
        aggs += [F.sum(F.when(hit & y, 1).otherwise(0)).alias(f"_t{i}"), F.sum(F.when(hit, 1).otherwise(0)).alias(f"_h{i}")]
    g = df.groupBy(*by).agg(*aggs)
    cells = [F.struct(F.lit(n).alias("rule"), F.col(f"_t{i}").alias("tp"), F.col(f"_h{i}").alias("predicted")) for i, n in enumerate(rules)]
    d = g.select(*by, "_p", "_n", F.explode(F.array(*cells)).alias("c")).select(*by, "c.*", "_p", "_n")
    return finish_confusion(d, by)


def finish_confusion(d: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From (.., rule, tp, predicted, _p, _n)."""
    tp, pr, P, N = (F.col(c) for c in ("tp", "predicted", "_p", "_n"))
    return d.select(
        *by, "rule", "tp", (pr - tp).alias("fp"), (P - tp).alias("fn"), (N - P - pr + tp).alias("tn"), "predicted",
        ratio(tp, pr).alias("precision"), ratio(tp, P).alias("recall"),
        F.when(tp > 0, F.lit(2.0) * tp / (pr + P)).otherwise(F.lit(0.0)).alias("f1"),
        ratio(N - P - pr + tp + tp, N).alias("accuracy"),
    )


def threshold_sweep(df: DataFrame, value: str, cuts: Sequence[float], label: str = "y", sign: str = ">", by: Sequence[str] = ()) -> DataFrame:
    """Rule metrics for a fixed list of cuts on one column.

    Rows are first counted per interval between cuts, so the cuts meet a handful
    of counts instead of every row.
    """
    cs = sorted(float(c) for c in cuts)
    v = F.col(value)
    at = F.lit(0)
    for c in cs:
        at = at + F.when((v > c) if sign == ">" else (v >= c) if sign == ">=" else (v > c), 1).otherwise(0)
    counted = df.groupBy(*by, at.alias("_at")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n")
    )
    aggs = [F.sum("p").alias("_p"), F.sum("n").alias("_n")]
    for i in range(len(cs)):
        hit = (F.col("_at") <= i) if sign == "<=" else (F.col("_at") > i)
        aggs += [F.sum(F.when(hit, F.col("p")).otherwise(0)).alias(f"_t{i}"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"_h{i}")]
    g = counted.groupBy(*by).agg(*aggs)
    cells = [F.struct(F.lit(c).alias("rule"), F.col(f"_t{i}").alias("tp"), F.col(f"_h{i}").alias("predicted")) for i, c in enumerate(cs)]
    d = g.select(*by, "_p", "_n", F.explode(F.array(*cells)).alias("c")).select(*by, "c.*", "_p", "_n")
    return finish_confusion(d, by).withColumnRenamed("rule", "cut")


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, low, high, mean, std, median); the median is exact and distributed."""
    g = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    q = exact_quantiles(df, keys, value, [0.5]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("qs")[0].alias("median"))
    if not keys:
        return g.crossJoin(q)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return g.join(q, cond).drop(*[f"_{k}" for k in keys])


def rate_by_group(df: DataFrame, keys: Sequence[str], label: str, min_n: int) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("rate")
    ).where(F.col("n") >= min_n)


def log_bin(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based log-spaced bin, NULL outside [lo, hi)."""
    step = (math.log10(hi) - math.log10(lo)) / bins
    b = F.floor((F.log10(value) - math.log10(lo)) / step).cast("int")
    return F.when((value >= lo) & (value < hi), b)


def mixed_bins(df: DataFrame, x: Column, y: Column, label: str, lo: float, hi: float, bins: int = 19, min_n: int = 5) -> DataFrame:
    """2-D log bins that hold both outcomes."""
    d = df.select(log_bin(x, lo, hi, bins).alias("bx"), log_bin(y, lo, hi, bins).alias("by"), F.col(label).alias("_y")).dropna()
    return d.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate")).where(
        (F.col("n") >= min_n) & (F.col("rate") > 0.05) & (F.col("rate") < 0.95)
    )


def family_extent(df: DataFrame, key: str, amplitude: Column, ok: Column, default: float) -> DataFrame:
    a = F.abs(amplitude)
    return df.groupBy(key).agg(
        F.coalesce(F.max(F.when(ok, a)), F.lit(0.0)).alias("max_ok"),
        F.coalesce(F.min(F.when(~ok, a)), F.lit(default)).alias("min_not_ok"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("n_ok"),
        F.count(F.lit(1)).alias("n"),
    )


def median_split(df: DataFrame, value: str, label: str) -> DataFrame:
    """Positive rate at or below and above the median, and their ratio."""
    m = exact_quantiles(df, [], value, [0.5]).select(F.col("qs")[0].alias("_m"))
    j = df.crossJoin(F.broadcast(m))  # one row
    low = F.col(value) <= F.col("_m")
    return j.agg(
        F.max("_m").alias("median"), F.avg(F.when(low, F.col(label))).alias("rate_low"), F.avg(F.when(~low, F.col(label))).alias("rate_high")
    ).withColumn("ratio", F.col("rate_low") / (F.col("rate_high") + 1e-30))


def r2_raw(df: DataFrame, predictions: dict[str, Column], target: str) -> DataFrame:
    """(name, r2) with the raw value as the prediction; target mean from a first pass."""
    mean = df.agg(F.avg(target).alias("_m"))
    j = df.crossJoin(F.broadcast(mean))
    t = F.col(target)
    tot = F.sum((t - F.col("_m")) * (t - F.col("_m")))
    aggs = [tot.alias("_tot")] + [F.sum((t - p) * (t - p)).alias(f"_r{i}") for i, p in enumerate(predictions.values())]
    g = j.agg(*aggs)
    cells = [F.struct(F.lit(n).alias("name"), (F.lit(1.0) - F.col(f"_r{i}") / (F.col("_tot") + 1e-30)).alias("r2")) for i, n in enumerate(predictions)]
    return g.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def linear_fits(df: DataFrame, predictors: dict[str, Column], target: str) -> DataFrame:
    """(name, slope, intercept, r2) of target = slope * value + intercept, all in one aggregate."""
    aggs = []
    for i, p in enumerate(predictors.values()):
        aggs += [F.regr_slope(target, p).alias(f"_a{i}"), F.regr_intercept(target, p).alias(f"_b{i}"), F.regr_r2(target, p).alias(f"_r{i}")]
    g = df.agg(*aggs)
    cells = [
        F.struct(F.lit(n).alias("name"), F.col(f"_a{i}").alias("slope"), F.col(f"_b{i}").alias("intercept"), F.coalesce(F.col(f"_r{i}"), F.lit(0.0)).alias("r2"))
        for i, n in enumerate(predictors)
    ]
    return g.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(name, r) over rows where both are finite."""
    def fin(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)

    g = df.agg(*[F.corr(fin(c), fin(target)).alias(f"_{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"_{i}").alias("r")) for i, c in enumerate(columns)]
    return g.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


# --- information ------------------------------------------------------------


def entropy_of(counts: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., h) from (by.., keys.., n)."""
    g = counts.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return g.withColumn("_p", p).groupBy(*by).agg(F.sum(-F.col("_p") * F.ln(F.col("_p") + 1e-30)).alias("h"))


def entropies(df: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """One row with an entropy per named key set; the table is counted once."""
    every = sorted({k for s in sets.values() for k in s})
    counts = df.groupBy(*every).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for name, keys in sets.items():
        h = entropy_of(counts, keys).select(F.col("h").alias(name))
        out = h if out is None else out.crossJoin(h)
    return out


def mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    e = entropies(df, {"ha": [a], "hb": [b], "hab": [a, b]})
    return e.withColumn("mi", F.greatest(F.col("ha") + F.col("hb") - F.col("hab"), F.lit(0.0)))


def percentile_bins(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``<column>_bin``: number of interior percentile cuts at or below the value.

    Cuts of all columns come from one long table keyed by the column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    cuts = exact_quantiles(long, ["c"], "v", [(i + 1) / bins for i in range(bins - 1)], small_keys=True)
    one = cuts.groupBy().pivot("c", list(columns)).agg(F.first("qs"))  # one row
    named = one.select(*[F.col(c).alias(f"_q_{c}") for c in columns])
    j = df.crossJoin(F.broadcast(named))
    out = {}
    for c in columns:
        b = F.lit(0)
        for i in range(bins - 1):
            b = b + F.when(F.col(c) >= F.get(F.col(f"_q_{c}"), F.lit(i)), 1).otherwise(0)
        out[f"{c}_bin"] = b
    return j.withColumns(out).drop(*named.columns)


def cond_mutual_info(binned: DataFrame, base: str, features: Sequence[str], label: str = "y") -> DataFrame:
    """(feature, cmi): I(feature; label | base), never below 0.

    One long count table with the feature as a key serves all features.
    """
    long = binned.select(base, label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("g")) for f in features])).alias("s")).select(base, label, "s.*")
    counts = long.groupBy("feature", "g", base, label).agg(F.count(F.lit(1)).alias("n"))
    sets = {"hgf": ["g", base], "hf": [base], "hgfy": ["g", base, label], "hfy": [base, label]}
    out = None
    for name, keys in sets.items():
        h = entropy_of(counts, keys, ["feature"]).withColumnRenamed("h", name)
        out = h if out is None else out.join(h, "feature")
    return out.select("feature", F.greatest(F.col("hgf") - F.col("hf") - F.col("hgfy") + F.col("hfy"), F.lit(0.0)).alias("cmi"))


# --- comparisons ------------------------------------------------------------


def paired_compare(scores: DataFrame, ours: str, base: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., n, mean, diff, sd, t, sigma, dir, p) of paired differences; p is two-sided."""
    d = F.col(ours) - F.col(base)
    g = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(base).alias("mean"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("sd")
    )
    t = F.when(F.col("sd") > 0, F.col("diff") / (F.col("sd") / F.sqrt(F.col("n")))).otherwise(F.lit(0.0))
    return g.withColumn("t", t).withColumn("sigma", F.abs("t")).withColumn("dir", F.when(F.col("diff") > 0, "ahead").otherwise("behind")).withColumn("p", F.when(F.col("n") > 1, student_p(F.col("t"), F.col("n") - 1)))


def corrected_t(compared: DataFrame, folds: int) -> DataFrame:
    """Adds the t value with the variance corrected for overlapping training sets."""
    var = F.col("sd") * F.col("sd") * (F.lit(1.0) / F.col("n") + F.lit(1.0 / (folds - 1)))
    return compared.withColumn("t_corrected", F.when(var > 0, F.col("diff") / F.sqrt(var)).otherwise(F.lit(0.0)))


def ci_outcome(compared: DataFrame, margin: float = 0.005, z: float = 1.96) -> DataFrame:
    """95 % interval of the difference, and win, tie or loss."""
    half = F.lit(z) * F.col("sd") / F.sqrt(F.col("n"))
    c = compared.withColumns({"low": F.col("diff") - half, "high": F.col("diff") + half})
    tie = (F.abs("diff") < margin) | ((F.col("low") <= 0) & (F.col("high") >= 0))
    return c.withColumn("outcome", F.when(tie, "tie").when(F.col("diff") > 0, "win").otherwise("loss"))


FRACTION_STEPS = 200  # far more than the continued fraction needs on either side of its switch


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a >= 1/2: Stirling's series at a + 16, brought down by the recurrence."""
    z = a + 16
    series = F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * F.pow(z, F.lit(3))) - 21 / (32768 * F.pow(z, F.lit(4))) - 399 / (262144 * F.pow(z, F.lit(5))))
    for k in range(16):
        series = series * (a + k) / (a + k + 0.5)
    return series


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last of a fixed number of terms."""

    def term(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(F.pmod(k, F.lit(2)) == 0, even).otherwise(odd) / acc

    return 1 / F.aggregate(F.sequence(F.lit(FRACTION_STEPS), F.lit(1), F.lit(-1)), F.lit(1.0), term)


def _tail_fraction(a: Column, y: Column) -> Column:
    """The continued fraction of the incomplete beta function with b = 1/2 at 1 - y that holds near 1: it needs y and
    a y alone, so very many degrees of freedom cost no digits."""
    b, x = F.lit(0.5), 1 - y
    lean = a * y - b * x

    def term(acc: Column, k: Column) -> Column:
        n = k - 1
        inner = F.when(n > 0, n * (b - n) * x / (a + 2 * n - 1)).otherwise(0.0)
        beta = n + inner + (a + n) / (a + 2 * n + 1) * (lean + 1 + n * (1 + y))
        alpha = (a + k - 1) * (a + b + k - 1) * k * (b - k) * x * x / ((a + 2 * k - 1) * (a + 2 * k - 1))
        return beta + alpha / acc

    return 1 / F.aggregate(F.sequence(F.lit(FRACTION_STEPS), F.lit(1), F.lit(-1)), F.lit(2.0 * FRACTION_STEPS), term)


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t: the incomplete beta function at dof / (dof + t^2), by a fixed number of steps for
    any number of degrees of freedom."""
    t, dof = t.cast("double"), dof.cast("double")
    a, half, far = dof / 2, F.lit(0.5), t * t / (dof + t * t)
    front = F.exp(-a * F.log1p(t * t / dof)) * F.sqrt(far) * _gamma_ratio(a) / math.sqrt(math.pi)
    tail = front * _tail_fraction(a, far)
    body = 1 - front / half * _beta_fraction(half, a, far)
    p = F.when(t * t >= 3, tail).otherwise(body)
    return F.when(t == 0, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))

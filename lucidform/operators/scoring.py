"""Exact scores of formulas over all rows, in one lazy plan.

``score`` explodes (row, candidate) to values, counts positives and rows per
distinct value before the shuffle, and reads F1, AUROC and thresholds off tie-safe
running totals.  It is meant for up to ``CHUNK`` candidates; larger sets go
through ``screening`` first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import Trace, project_formulas, text
from lucidform.operators.ranking import quantiles_of, tie_prefix
from lucidform.sources.labelled import Labelled, spread

CHUNK = 48
VAR_FLOOR = 1e-20  # below this variance a formula counts as constant

# The percentiles swept by the quick threshold search.
SWEEP = (20, 30, 40, 50, 60, 70, 75, 80, 85, 90, 95)


def long_values(
    lab: Labelled, traces: Sequence[Trace], by: Sequence[str] = (), ops: OpSet | None = None
) -> DataFrame:
    """(by.., y, cand, v): one row per input row and candidate."""
    src = spread(lab.df.select(*by, lab.label, *lab.features))
    wide = project_formulas(src, lab.features, traces, keep=[*by, F.col(lab.label).alias("y")], ops=ops)
    vs = [F.col(f"v{k}") for k in range(len(traces))]
    return wide.select(*by, "y", F.posexplode(F.array(*vs)).alias("cand", "v"))


def value_counts(
    lab: Labelled, traces: Sequence[Trace], by: Sequence[str] = (), ops: OpSet | None = None
) -> DataFrame:
    """(by.., cand, v, p, n): positives and rows per distinct value."""
    return count_values(long_values(lab, traces, by, ops), [*by, "cand"])


def count_values(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys, "v").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))


def f1_down(tp: Column, predicted: Column, positives: Column) -> Column:
    return F.lit(2.0) * tp / (predicted + positives)


def scores_from_prefix(prefix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best F1 with its direction and threshold, and AUROC, per key.

    Predicting ``direction * v >= threshold``.  Equal F1 prefers direction +1,
    then the larger threshold.
    """
    tp, npred, p, n, P, N = (F.col(c) for c in ("tp", "np", "p", "n", "pos", "tot"))
    down = F.struct(f1_down(tp, npred, P).alias("f1"), F.lit(1).alias("direction"), F.col("v").alias("threshold"))
    up = F.struct(
        f1_down(P - tp + p, N - npred + n, P).alias("f1"), F.lit(-1).alias("direction"), (-F.col("v")).alias("threshold")
    )
    neg_below = (N - P) - (npred - tp)
    agg = prefix.groupBy(*keys).agg(
        F.max(F.greatest(down, up)).alias("best"),
        F.sum(p.cast("double") * (neg_below + (n - p) / F.lit(2.0))).alias("_u"),
        F.max("pos").alias("positives"),
        F.max("tot").alias("rows"),
        F.max("var").alias("var"),
    )
    P, N = F.col("positives"), F.col("rows")
    single = (P == 0) | (P == N)
    dead = single | (F.col("var") < VAR_FLOOR)
    a = F.col("_u") / (P.cast("double") * (N - P))
    return agg.select(
        *keys,
        F.when(dead, F.lit(0.0)).otherwise(F.col("best.f1")).alias("f1"),
        F.when(single, F.lit(0.5)).otherwise(F.greatest(F.try_divide(F.col("_u"), P.cast("double") * (N - P)), F.lit(1.0) - F.try_divide(F.col("_u"), P.cast("double") * (N - P)))).alias("auroc"),
        F.col("best.direction").alias("direction"),
        F.col("best.threshold").alias("threshold"),
        "positives",
        "rows",
        "var",
    )


def with_formula(scores: DataFrame, lab: Labelled, traces: Sequence[Trace]) -> DataFrame:
    """Candidate positions replaced by formula text."""
    names = F.array(*[F.lit(text(t, lab.features)) for t in traces])
    return scores.withColumn("formula", F.get(names, F.col("cand"))).drop("cand")


def _chunks(traces: Sequence[Trace]) -> list[Sequence[Trace]]:
    return [traces[i : i + CHUNK] for i in range(0, len(traces), CHUNK)]


def score(
    lab: Labelled, traces: Sequence[Trace], by: Sequence[str] = (), ops: OpSet | None = None
) -> DataFrame:
    """(by.., formula, f1, auroc, direction, threshold, positives, rows, var)."""
    parts = [
        with_formula(
            scores_from_prefix(tie_prefix(value_counts(lab, part, by, ops), [*by, "cand"], small_keys=not by), [*by, "cand"]), lab, part
        )
        for part in _chunks(list(traces))
    ]
    return reduce(DataFrame.unionByName, parts)


def score_column(df: DataFrame, value: Column, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """The same scores for one existing column, per group."""
    long = df.select(*by, F.col(label).alias("y"), value.alias("v"))
    return scores_from_prefix(tie_prefix(count_values(long, by), by, small_keys=False), by)


def covers_percentile(percentiles: Sequence[float]) -> Column:
    """Whether a row of running totals holds an order statistic of any percentile."""
    first = F.col("tot") - F.col("np")
    hit = F.lit(False)
    for q in percentiles:
        pos = (F.col("tot") - 1) * F.lit(float(q)) / F.lit(100.0)
        for rank in (F.floor(pos), F.ceil(pos)):
            hit = hit | ((rank >= first) & (rank < first + F.col("n")))
    return hit


def cut_table(prefix: DataFrame, keys: Sequence[str], percentiles: Sequence[float], both: bool = True) -> DataFrame:
    """One row per (keys, percentile, direction): counts for that cut.

    A percentile lies at one or between two neighbouring values, so the rows of
    the running totals that cover those ranks say what is above and below it.
    """
    first = F.col("tot") - F.col("np")
    pos = (F.col("tot") - 1) * F.col("percentile") / F.lit(100.0)
    on_lo = (F.floor(pos) >= first) & (F.floor(pos) < first + F.col("n"))
    on_hi = (F.ceil(pos) >= first) & (F.ceil(pos) < first + F.col("n"))
    # exploding keeps the compiled code small, which is faster than one long predicate
    hits = prefix.withColumn("percentile", F.explode(F.array(*[F.lit(float(q)) for q in percentiles]))).where(on_lo | on_hi)
    at = F.struct("v", "tp", "np", "p", "n")
    ends = hits.groupBy(*keys, "percentile").agg(
        F.max(F.when(on_lo, at)).alias("lo"),
        F.max(F.when(on_hi, at)).alias("hi"),
        F.max(pos - F.floor(pos)).alias("frac"),
        F.max("pos").alias("pos"),
        F.max("tot").alias("tot"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    cut = F.when(lo["v"] == hi["v"], lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * F.col("frac"))
    ends = ends.withColumn("threshold", cut)
    t = F.col("threshold")
    above = F.when(hi["v"] > t, F.struct(hi["tp"].alias("tp"), hi["np"].alias("np"))).otherwise(
        F.struct((hi["tp"] - hi["p"]).alias("tp"), (hi["np"] - hi["n"]).alias("np"))
    )
    below = F.when(
        lo["v"] < t,
        F.struct((F.col("pos") - lo["tp"] + lo["p"]).alias("tp"), (F.col("tot") - lo["np"] + lo["n"]).alias("np")),
    ).otherwise(F.struct((F.col("pos") - lo["tp"]).alias("tp"), (F.col("tot") - lo["np"]).alias("np")))
    sides = [F.struct(F.lit(">").alias("direction"), above["tp"].alias("tp"), above["np"].alias("predicted"))]
    if both:
        sides.append(F.struct(F.lit("<").alias("direction"), below["tp"].alias("tp"), below["np"].alias("predicted")))
    return (
        ends.select(*keys, "percentile", "threshold", "pos", "tot", F.explode(F.array(*sides)).alias("c"))
        .select(*keys, "percentile", "threshold", "pos", "tot", "c.*")
        .withColumn(
            "f1",
            F.when(F.col("tp") > 0, F.lit(2.0) * F.col("tp") / (F.col("predicted") + F.col("pos"))).otherwise(F.lit(0.0)),
        )
    )


def best_cut(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest F1 per key; ties go to the lowest percentile, then ``>``."""
    pick = F.struct("f1", (-F.col("percentile")).alias("p"), F.col("direction"), F.col("threshold"))
    return cuts.groupBy(*keys).agg(F.max(pick).alias("b")).select(
        *keys,
        F.col("b.f1").alias("f1"),
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(0.0)).alias("threshold"),
        F.when(F.col("b.f1") > 0, F.col("b.direction")).otherwise(F.lit(">")).alias("direction"),
    )


def percentile_f1(
    lab: Labelled,
    traces: Sequence[Trace],
    percentiles: Sequence[float] = SWEEP,
    by: Sequence[str] = (),
    ops: OpSet | None = None,
) -> DataFrame:
    """(by.., formula, f1, threshold, direction) of the quick sweep with exact percentiles."""
    parts = []
    for part in _chunks(list(traces)):
        keys = [*by, "cand"]
        prefix = tie_prefix(value_counts(lab, part, by, ops), keys, small_keys=not by)
        parts.append(with_formula(best_cut(cut_table(prefix, keys, percentiles), keys), lab, part))
    return reduce(DataFrame.unionByName, parts)


def predict(value: Column, direction: Column | int, threshold: Column | float) -> Column:
    """0/1: ``direction * value >= threshold``."""
    d = F.lit(direction) if isinstance(direction, int) else direction
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return F.when(d * value >= t, 1).otherwise(0)

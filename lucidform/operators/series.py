"""Closest return and drift of recorded series (series, t, state.., metric)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closest_return(
    df: DataFrame, series: str, t: Column, state: Sequence[str], skip: float = 0.1, threshold: float = 0.05
) -> DataFrame:
    """Per series: nearest approach to the first state after the first ``skip`` of
    its steps, when it happened, and whether it counts as periodic.

    Two partial aggregates and a join on the series; no per-series sort.  Steps
    are numbered by time order through a rank of distinct times, which the
    aggregate needs only as a cut, so the cut is the exact ``skip`` quantile.
    """
    from lucidform.operators.ranking import tie_prefix

    s = df.select(F.col(series).alias("series"), t.alias("t"), *state)
    bad = None
    for c in state:
        x = F.col(c).isNull() | F.isnan(c)
        bad = x if bad is None else bad | x
    first = s.groupBy("series").agg(
        F.min_by(F.struct(*state), F.struct("t", *state)).alias("x0"),
        F.count(F.lit(1)).alias("steps"),
        F.max(bad).alias("collision"),
    )
    counts = s.groupBy("series", F.col("t").alias("v")).agg(F.lit(0).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    ranks = tie_prefix(counts, ["series"], small_keys=False)
    # 0-based index of the first row at this time
    start = ranks.select("series", F.col("v").alias("t"), (F.col("tot") - F.col("np")).alias("idx"), "tot")
    late = start.where(F.col("idx") > F.floor((F.col("tot") - 1) * F.lit(skip))).select("series", "t")
    dist2 = None
    for c in state:
        dx = F.col(c) - F.col(f"x0.{c}")
        dist2 = dx * dx if dist2 is None else dist2 + dx * dx
    d = s.join(first.where(~F.col("collision")), "series").join(late, ["series", "t"], "left_semi")
    near = d.withColumn("dist", F.sqrt(dist2)).groupBy("series").agg(
        F.min("dist").alias("return_distance"), F.min_by("t", F.struct("dist", "t")).alias("return_time")
    )
    extent = None
    for c in state:
        x = F.col(f"x0.{c}")
        extent = x * x if extent is None else extent + x * x
    out = first.join(near, "series", "left")
    return out.select(
        "series",
        "steps",
        "collision",
        "return_distance",
        "return_time",
        F.coalesce(F.col("return_distance") / (F.sqrt(extent) + 1e-30) < threshold, F.lit(False)).alias("is_periodic"),
    )


def drift(df: DataFrame, series: str, t: Column, metric: str) -> DataFrame:
    """(series, drift): relative change of a metric from first to last time."""
    g = df.groupBy(F.col(series).alias("series")).agg(
        F.min_by(metric, F.struct(t, F.col(metric))).alias("_a"), F.max_by(metric, F.struct(t, F.col(metric))).alias("_b")
    )
    return g.select("series", (F.abs(F.col("_b") - F.col("_a")) / (F.abs("_a") + 1e-30)).alias("drift"))

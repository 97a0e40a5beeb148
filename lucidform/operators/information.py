"""Feature relevance by binned information measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.operators.metrics import cond_mutual_info, entropy_of, percentile_bins
from lucidform.operators.scoring import scores_from_prefix
from lucidform.operators.ranking import tie_prefix
from lucidform.sources.labelled import Labelled


def feature_mi(lab: Labelled, bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information of each binned feature with the label."""
    b = percentile_bins(lab.df.select(lab.label, *lab.features), lab.features, bins)
    long = b.select(lab.label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_bin").alias("g")) for f in lab.features])).alias("s")).select(lab.label, "s.*")
    counts = long.groupBy("feature", "g", lab.label).agg(F.count(F.lit(1)).alias("n"))
    hg = entropy_of(counts, ["g"], ["feature"]).withColumnRenamed("h", "hg")
    hy = entropy_of(counts, [lab.label], ["feature"]).withColumnRenamed("h", "hy")
    hgy = entropy_of(counts, ["g", lab.label], ["feature"]).withColumnRenamed("h", "hgy")
    j = hg.join(hy, "feature").join(hgy, "feature")
    return j.select("feature", F.greatest(F.col("hg") + F.col("hy") - F.col("hgy"), F.lit(0.0)).alias("mi"))


def informative_features(lab: Labelled, share: float = 0.1, least: int = 3) -> DataFrame:
    """Features with at least ``share`` of the largest MI; all of them when fewer
    than ``least`` would stay."""
    from pyspark.sql import Window

    m = feature_mi(lab)
    w = Window.partitionBy()  # one row per feature
    top = m.withColumn("_t", F.max("mi").over(w))
    hit = top.withColumn("_k", F.col("mi") >= F.lit(share) * F.col("_t")).withColumn("_n", F.sum(F.col("_k").cast("int")).over(w))
    return hit.where(F.col("_k") | (F.col("_n") < least)).select("feature", F.round("mi", 6).alias("mi"))


def irrelevant_features(lab: Labelled, base: str, tau: float = 0.01, bins: int = 10) -> DataFrame:
    """(feature, cmi): features that add less than tau given the base feature."""
    others = [f for f in lab.features if f != base]
    b = percentile_bins(lab.df.select(lab.label, *lab.features), lab.features, bins)
    c = cond_mutual_info(b.withColumnRenamed(lab.label, "y") if lab.label != "y" else b, f"{base}_bin", [f"{f}_bin" for f in others])
    return c.where(F.col("cmi") < tau).select(F.regexp_replace("feature", "_bin$", "").alias("feature"), "cmi")


def pair_scores(lab: Labelled, grid: int = 10) -> DataFrame:
    """(a, b, f1): best F1 when rows are ranked by the positive rate of their cell
    in a grid over two features.  Advisory: not a bound for formulas."""
    b = percentile_bins(lab.df.select(lab.label, *lab.features), lab.features, grid)
    pairs = [(x, y) for i, x in enumerate(lab.features) for y in lab.features[i + 1 :]]
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), (F.col(f"{x}_bin") * (grid + 1) + F.col(f"{y}_bin")).alias("cell")) for x, y in pairs]
    long = b.select(F.col(lab.label).alias("_y"), F.explode(F.array(*cells)).alias("s")).select("_y", "s.*")
    per = long.groupBy("a", "b", "cell").agg(F.sum("_y").alias("p"), F.count(F.lit(1)).alias("n"))
    rate = per.withColumn("v", F.col("p") / F.col("n")).groupBy("a", "b", "v").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return scores_from_prefix(tie_prefix(rate, ["a", "b"], levels=4), ["a", "b"]).select("a", "b", "f1")


def prunable_pairs(pairs: DataFrame, best: float) -> DataFrame:
    """(pairs, prunable, rate): pairs whose score is below the best found."""
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.when(F.col("f1") < best, 1).otherwise(0)).alias("prunable")
    ).withColumn("rate", F.col("prunable") / F.col("pairs"))

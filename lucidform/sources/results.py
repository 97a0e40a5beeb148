"""Result and landscape files, pending work and run sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "name string, N long, d int, test_f1 double, train_f1 double, formula string, stability double, "
    "baselines struct<GB:struct<mean:double,diff:double,sigma:double,dir:string>,"
    "RF:struct<mean:double,diff:double,sigma:double,dir:string>,"
    "LR:struct<mean:double,diff:double,sigma:double,dir:string>>, _corrupt string"
)


def write_landscape(df: DataFrame, path: str, partition: str = "scenario") -> None:
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def read_landscape(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON document per line, appended."""
    df.write.mode("append").json(path)


def collect_results(spark: SparkSession, path: str) -> DataFrame:
    """Flat dashboard rows from nested result documents; ``rejected_results`` has those that can't be read."""
    raw = spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    d = raw.where(F.col("_corrupt").isNull())

    def versus(m: str) -> Column:
        b = F.col(f"baselines.{m}")
        return F.concat_ws(" ", F.format_string("%.1f", F.coalesce(b["sigma"], F.lit(0.0))), F.coalesce(b["dir"], F.lit("?")))

    return d.select(
        F.coalesce("name", F.lit("?")).alias("name"),
        F.coalesce("N", F.lit(0)).alias("N"),
        F.coalesce("d", F.lit(0)).alias("d"),
        F.coalesce("test_f1", F.lit(0.0)).alias("test_f1"),
        F.coalesce("train_f1", F.lit(0.0)).alias("train_f1"),
        F.substring(F.coalesce("formula", F.lit("?")), 1, 40).alias("formula"),
        versus("GB").alias("vs_gb"),
        versus("RF").alias("vs_rf"),
        versus("LR").alias("vs_lr"),
        F.coalesce(F.col("baselines.GB.dir") == "ahead", F.lit(False)).alias("beats_gb"),
    )


def rejected_results(spark: SparkSession, path: str) -> DataFrame:
    """(document) of what is no readable result document."""
    raw = spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("document"))


def pending_jobs(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return jobs.join(done.select(key), key, "left_anti")


def size_class(n: Column, d: Column) -> list[Column]:
    """Repeats, beam width, subspaces and subspace size by table size."""
    # Size limits and the settings above each.
    rows = ((50_000, 20, 50, 5, 8, 4), (10_000, 50, 50, 8, 10, 4), (2_000, 100, 100, 10, 10, 8), (-1, 200, 100, 15, 12, 8))

    def pick(i: int) -> Column:
        out = None
        for r in rows:
            out = F.when(n > r[0], F.lit(r[i])) if out is None else out.when(n > r[0], F.lit(r[i]))
        return out

    return [
        pick(1).alias("repeats"),
        pick(2).alias("beam"),
        pick(3).alias("subspaces"),
        F.least(pick(4), d + pick(5)).alias("subspace_k"),
    ]

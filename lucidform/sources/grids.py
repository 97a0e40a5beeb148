"""Parameter grids, reproducible random draws and fixture tables with known truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def param_grid(
    spark: SparkSession, n_r1: int, n_r2: int, n_theta: int, n_phi: int, r_min: float = 0.1, r_max: float = 100.0
) -> DataFrame:
    """r1, r2 log-spaced with both ends; theta in [0, 2 pi) open, phi in [0, pi] closed."""

    def axis(n: int, name: str, value) -> DataFrame:
        return spark.range(n).select(value(F.col("id").cast("double")).alias(name))

    lo, hi = math.log10(r_min), math.log10(r_max)

    def logs(n: int):
        return lambda i: F.pow(F.lit(10.0), F.lit(lo) + i * ((hi - lo) / max(1, n - 1)))

    return (
        axis(n_r1, "r1", logs(n_r1))
        .crossJoin(F.broadcast(axis(n_r2, "r2", logs(n_r2))))
        .crossJoin(F.broadcast(axis(n_theta, "theta", lambda i: i * (2 * math.pi / n_theta))))
        .crossJoin(F.broadcast(axis(n_phi, "phi", lambda i: i * (math.pi / max(1, n_phi - 1)))))
    )


def uniform(seed: int | str, rid: Column) -> Column:
    """A number in [0, 1) that depends on seed and identity only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), rid)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def random_configs(df: DataFrame, rid: Column, r_min: float = 0.1, r_max: float = 100.0, seed: int = 42) -> DataFrame:
    """Log-uniform radii and uniform angles per row."""
    lo, hi = math.log10(r_min), math.log10(r_max)
    return df.withColumns(
        {
            "r1": F.pow(F.lit(10.0), F.lit(lo) + uniform(f"{seed}r1", rid) * (hi - lo)),
            "r2": F.pow(F.lit(10.0), F.lit(lo) + uniform(f"{seed}r2", rid) * (hi - lo)),
            "theta": uniform(f"{seed}t", rid) * (2 * math.pi),
            "phi": uniform(f"{seed}p", rid) * math.pi,
        }
    )


def fixture(df: DataFrame, rid: Column, kind: str, seed: int = 7) -> DataFrame:
    """(rid, x1, x2, y) with a known rule: circles, linear or product."""
    half = {"circles": 2.0, "linear": 5.0, "product": 3.0}[kind]
    d = df.select(
        rid.alias("rid"),
        ((uniform(f"{seed}a", rid) * 2.0 - 1.0) * half).alias("x1"),
        ((uniform(f"{seed}b", rid) * 2.0 - 1.0) * half).alias("x2"),
    )
    rule = {
        "circles": F.col("x1") * F.col("x1") + F.col("x2") * F.col("x2") < 1,
        "linear": F.col("x1") + F.col("x2") > 0,
        "product": F.col("x1") * F.col("x2") > 1,
    }[kind]
    return d.withColumn("y", F.when(rule, 1).otherwise(0))


# Known closed forms over three inputs a, b, c.
EQUATIONS = {
    "gaussian": lambda a, b, c: F.exp(-(a / b) * (a / b) / 2.0) / (b * math.sqrt(2 * math.pi)),
    "gravity": lambda a, b, c: a * b / (c * c),
    "coulomb": lambda a, b, c: a * b / (F.lit(4 * math.pi) * c * c),
    "relativistic_mass": lambda a, b, c: a / F.sqrt(F.lit(1.0) - (c / 10.0) * (c / 10.0)),
    "thin_lens": lambda a, b, c: F.lit(1.0) / (F.lit(1.0) / a + c / b),
    "sum_of_squares": lambda a, b, c: a * a + b * b,
}


def equation_table(df: DataFrame, rid: Column, name: str, seed: int = 11) -> DataFrame:
    a, b, c = (F.lit(1.0) + uniform(f"{seed}{x}", rid) * 4.0 for x in "abc")
    d = df.select(rid.alias("rid"), a.alias("a"), b.alias("b"), c.alias("c"))
    return d.withColumn("y", EQUATIONS[name](F.col("a"), F.col("b"), F.col("c")))

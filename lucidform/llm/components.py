"""Connected components by alternating large-star and small-star, as joins and aggregations.

Large-star links every larger neighbour of a node to the node's smallest neighbour (or itself); small-star does so
for the smaller neighbours and the node.  When neither changes the links, they are stars around each component's
smallest node.  Smallest neighbours are partial minima, so a node with very many links is added up before the
shuffle; the join that hands a minimum to its links is between written tables, where Spark splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over distinct links (u > v), to distinct links (u > v)."""
    if large:
        seen = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-minima")
        moved = seen.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = cut(links.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
        near = links.join(least, "u")
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return cut(moved.where("u <> v").distinct(), "star-links")


def _mark(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
    return r["n"], int(r["h"] or 0)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable.

    Links may repeat, stand in either direction or loop; nulls link nothing; no links give no rows.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-links")
    before = _mark(now)
    for _ in range(most):
        if not before[0]:
            break
        now = _star(_star(now, True), False)
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

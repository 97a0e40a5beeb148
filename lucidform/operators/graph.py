"""Connected components by star contraction.

A large step links each larger neighbour of a node to the node's smallest neighbour, a small step does so for the
smaller neighbours; when neither changes the links, they are stars around each component's smallest node.  Smallest
neighbours are partial minima.  Handing them to the links is a join on the node; nodes with very many links are few by
count, so their minima are broadcast and the join that moves rows never meets them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.session import written

#: Nodes with more than 1 / HUBS of all links are hubs: at most that many.
HUBS = 100_000
LEAST_HUB = 10_000


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(u, v, m): links with the least neighbour of u from ``least`` (u, m, n)."""
    many = F.col("n") > max(LEAST_HUB, total // HUBS)
    hubs = least.where(many).select("u", "m")
    tagged = links.join(F.broadcast(hubs), "u", "left")  # at most HUBS rows
    done = tagged.where("m IS NOT NULL")
    return done.unionByName(tagged.where("m IS NULL").drop("m").join(least.where(~many).select("u", "m"), "u"))


def _step(links: DataFrame, large: bool, total: int) -> DataFrame:
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        out = _with_least(both.where("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = written(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        near = _with_least(links, least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = near.unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.where("u <> v").distinct(), "links")


def _mark(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): smallest node id reachable; nodes without edges are their own component."""
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    links = written(ends.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    before = _mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = _step(_step(links, True, before[0]), False, before[0])
        now = _mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))  # one row a node
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

"""Mix sources to target weights by nested hash thresholds over histograms.

A source's budget is so many whole passes over its documents and a rest.  The rest is a hash threshold: documents
below it are taken once more.  The threshold is found without sorting: sum sizes by (source, leading hash bits), find
the bucket in which the running sum crosses the rest, and look only into that bucket with the next bits, until it is
one hash value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidform.llm.common import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: Bits of a document's hash, and of one level of the histogram.
HASH_BITS, LEVEL_BITS = 60, 10
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are joined by broadcast.
FEW_SOURCES = 100_000


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, at most ``passes`` times its size, the excess reshared
    by weight.  Sources stand by code point, null last; the weights repeat over them."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    rows = sorted(((passes * n / weights[i % len(weights)], i, s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)), key=lambda r: r[:2])
    budget, weight = share * sum(n for _, n in sizes), sum(r[4] for r in rows)
    out, level = {}, None
    for _, _, source, n, w in rows:  # those whose limit is reached first
        if level is None and budget / weight * w > passes * n:
            out[source] = float(passes * n)
            budget, weight = budget - passes * n, weight - w
        else:
            level = budget / weight if level is None else level
            out[source] = level * w
    return out


def doc_hash() -> Column:
    """Hash bits of doc_id and text: other texts of a repeated or missing doc_id are drawn on their own."""
    both = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash): words of the whole text (null: 0) and 60 hash bits of doc_id and text.  Rows
    equal in both have equal hashes and are taken together; a null hashes like empty text."""
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        doc_hash().alias("hash"),
    )


def thresholds(sized: DataFrame, rests: dict[str | None, float]) -> dict[str | None, int]:
    """By source, the hash below which documents make up the rest as nearly as whole documents can.

    Runs ``HASH_BITS / LEVEL_BITS`` levels of a histogram with at most 2 ** LEVEL_BITS buckets a source.  The driver
    holds one bucket for each source.
    """
    spark = sized.sparkSession
    goal = [(s, float(r), 0, 0.0) for s, r in rests.items() if r > 0]
    found = {s: 0 for s, r in rests.items() if r <= 0}
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        if not goal:
            break
        at = few(spark.createDataFrame([(s or "", s is None, r, p, b) for s, r, p, b in goal], "name string, none boolean, rest double, prefix bigint, before double"), len(goal))
        inside = sized.join(at, (F.coalesce("source", F.lit("")) == F.col("name")) & (F.col("source").isNull() == F.col("none")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("name", "none", "rest", "before", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.col("before") + F.sum("size").over(Window.partitionBy("name", "none").orderBy("bucket"))
        crossed = sums.withColumn("upto", running).where("upto > rest").groupBy("name", "none", "rest").agg(F.min(F.struct("bucket", "upto", "size")).alias("first")).collect()
        goal = []
        for r in crossed:
            source, bucket, upto, size = None if r["none"] else r["name"], r["first"]["bucket"], r["first"]["upto"], r["first"]["size"]
            if shift:
                goal.append((source, r["rest"], bucket, float(upto - size)))
            else:  # one hash value: with it or without it, whichever is nearer
                found[source] = bucket + 1 if upto - r["rest"] < r["rest"] - (upto - size) else bucket
    return found


def few(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast, for a table of one row per source and only where that is small."""
    return F.broadcast(df) if rows <= FEW_SOURCES else df


def budget(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """A row for each source: (name, none, source_size, target, whole, below).  A document is taken ``whole`` times,
    and once more if its hash is under ``below``."""
    spark = sized.sparkSession
    total = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(list(total.items()), weights, share, passes)
    whole = {s: min(int(goal[s] // n), passes) if n else 0 for s, n in total.items()}
    cuts = thresholds(sized, {s: goal[s] - whole[s] * n for s, n in total.items()})
    rows = [(s or "", s is None, n, goal[s], whole[s], cuts.get(s, 1 << HASH_BITS)) for s, n in total.items()]
    return few(spark.createDataFrame(rows, "name string, none boolean, source_size bigint, target double, whole int, below bigint"), len(rows))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document.

    Null text counts 0 words, null source is a source of its own, an empty table gives no rows, repeated rows are
    taken alike.  Sources without words have target 0 and their documents are taken 0 times.  Other columns are
    ignored.  The driver holds one row for each source.
    """
    sized = cut(with_sizes(docs), "sizes")
    plan = budget(sized, weights, share, passes)
    copies = F.least(F.col("whole") + (F.col("hash") < F.col("below")).cast("int"), F.lit(passes))
    joined = sized.join(plan, (F.coalesce("source", F.lit("")) == F.col("name")) & (F.col("source").isNull() == F.col("none"))).withColumn("copies", copies)
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.  The rows don't move: a budget is a threshold."""
    plan = budget(cut(with_sizes(docs), "sizes"), weights, share, passes)
    plan = plan.select(*(F.col(c).alias(f"plan {c}") for c in plan.columns))
    own = (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("plan name")) & (F.col("source").isNull() == F.col("plan none"))
    copies = F.least(F.col("plan whole") + (doc_hash() < F.col("plan below")).cast("int"), F.lit(passes))
    taken = docs.join(plan, own).withColumn("plan copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return taken.select(*docs.columns)


#: The same in DuckDB's SQL: targets in closed form, thresholds by a running sum over distinct hashes.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15)) AS BIGINT) AS hash
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
ranked AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w, i) AS j FROM weighed),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(n) OVER () - 2 * coalesce(sum(n) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
cap AS (SELECT min(j) AS j FROM filled WHERE level * w <= 2 * n),
goal AS (
  SELECT source, n, CASE WHEN f.j < cap.j THEN 2.0 * n ELSE (SELECT level FROM filled WHERE filled.j = cap.j) * w END AS target FROM filled f, cap),
parts AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(floor(target / n), 2) END AS whole FROM goal),
steps AS (
  SELECT s.source, s.hash, sum(s.size) AS size FROM sized s GROUP BY ALL),
running AS (
  SELECT p.source, t.hash, t.size, sum(t.size) OVER (PARTITION BY p.source ORDER BY t.hash) AS upto, p.target - p.whole * p.n AS rest
  FROM steps t JOIN parts p ON t.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT source, hash, CASE WHEN rest > 0 AND (upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END AS more FROM running)
SELECT s.doc_id, s.size, p.n AS source_size, CAST(p.target AS DOUBLE) AS target,
       CAST(s.size * least(p.whole + t.more, 2) AS BIGINT) AS taken
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.hash = t.hash
"""

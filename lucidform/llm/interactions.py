"""How five filters interact: what each removes, where it stands in every order, and what only it would remove.

Every document fails some of the filters; all documents of a part with the same failures are one mask cell, a count
with labels.  A cell then folds across the array of all 120 orders: ``transform`` over orders, ``aggregate`` over the
five steps, giving 600 structs weighted by the cell's counts.  The at most 32 grids of a part are merged by elementwise
sums.  Documents are read once; what is folded has a bounded size for each part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import cut

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
WORD = r"[^\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bit of E in a mask; A to D have 1, 2, 4 and 8.
COPY = 16


def own_failures(text: str = "text") -> Column:
    """Bits of the filters that look at one text: A short, B repetitive words, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    tests = (
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        F.col(text).rlike("[#$%&*|]"),
    )
    return sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest, good, toxic) for every document; ``mask`` without E.

    A doc_id that is labelled several times is good (toxic) if any of its labels says so.
    """
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", own_failures().alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def cells(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, E included.

    E fails documents whose text some smaller doc_id has, in any part.  Equal texts have one mask, so the counts of
    all documents are moved to the failing side but for those with the least doc_id of each text: partial minima, no
    join of copies.  A null doc_id isn't smaller than any and has none smaller.
    """
    sums = [F.sum(F.lit(1).cast("bigint")).alias("n"), F.sum(F.col("good").cast("bigint")).alias("good"), F.sum(F.col("toxic").cast("bigint")).alias("toxic")]
    more = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    rows = cut(rows, "judged")
    totals = rows.groupBy("part", "mask", F.col("doc_id").isNotNull().alias("copy")).agg(*sums)
    ids = rows.where("doc_id IS NOT NULL").groupBy("digest", "mask", "doc_id", "part").agg(*sums)
    least = ids.groupBy("digest", "mask", "doc_id").agg(F.collect_list(F.struct("part", "n", "good", "toxic")).alias("parts"))
    least = least.groupBy("digest", "mask").agg(F.min(F.struct("doc_id", "parts")).alias("first"))
    firsts = least.select("mask", F.explode("first.parts").alias("p")).select("p.part", "mask", "p.n", "p.good", "p.toxic").groupBy("part", "mask").agg(*more)
    firsts = cut(firsts, "first-texts")
    moved = firsts.select("part", (F.col("mask") + COPY).alias("mask"), *((-F.col(c)).alias(c) for c in ("n", "good", "toxic")))
    whole = totals.select("part", (F.col("mask") + F.col("copy").cast("int") * COPY).alias("mask"), "n", "good", "toxic")
    return whole.unionByName(firsts).unionByName(moved).groupBy("part", "mask").agg(*more)


def _array(values: list[str]) -> str:
    return f"array({', '.join(repr(v) for v in values)})"


#: One cell's 600 structs: across the orders, a fold over the five steps that knows whether the cell is gone.
FOLD = f"""
flatten(transform(orders, o -> aggregate(
  sequence(1, {len(LETTERS)}),
  named_struct('gone', false, 'steps', cast(array() AS array<struct<{', '.join(f'{m}: bigint' for m in MEASURES)}>>)),
  (acc, k) -> named_struct(
    'gone', acc.gone OR (mask & shiftleft(1, ascii(substring(o, k, 1)) - 65)) <> 0,
    'steps', concat(acc.steps, array(transform(
      array(named_struct('bit', shiftleft(1, ascii(substring(o, k, 1)) - 65))),
      f -> named_struct(
        'kept', if(acc.gone OR (mask & f.bit) <> 0, 0L, n),
        'removed', if(NOT acc.gone AND (mask & f.bit) <> 0, n, 0L),
        'redundant', if(acc.gone AND (mask & f.bit) <> 0, n, 0L),
        'unique_fails', if(mask = f.bit, n, 0L),
        'good_lost', if(NOT acc.gone AND (mask & f.bit) <> 0, good, 0L),
        'toxic_lost', if(NOT acc.gone AND (mask & f.bit) <> 0, toxic, 0L)))[0]))),
  acc -> acc.steps)))
"""
MERGE = f"""
aggregate(slice(grids, 2, greatest(size(grids) - 1, 0)), grids[0],
  (acc, grid) -> zip_with(acc, grid, (x, y) -> named_struct({', '.join(f"'{m}', x.{m} + y.{m}" for m in MEASURES)})))
"""
SHAPLEY = f"""
transform({_array(list(LETTERS))}, l -> aggregate(
  zip_with(grid, letters, (g, x) -> if(x = l, g.removed, 0L)), 0L, (a, b) -> a + b))
"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (value of lang; null: empty string), order of the filters and step, zeros included.

    kept, removed, redundant, unique_fails, good_lost and toxic_lost count documents of the part; shapley adds up what
    the step's filter removes over all orders.  Null text is empty; very long texts are one row like any other; rows
    that repeat a doc_id count each; labels of unknown documents count nothing.  Other columns are ignored, and an
    empty table has no parts.
    """
    orders = F.expr(_array(ORDERS)).alias("orders")
    grids = cut(cells(judged(docs, labels)), "mask-cells").where("n > 0").select("part", "mask", "n", "good", "toxic", orders)
    merged = grids.select("part", F.expr(FOLD).alias("grid")).groupBy("part").agg(F.collect_list("grid").alias("grids")).select("part", F.expr(MERGE).alias("grid"))
    letters = F.expr(_array([letter for o in ORDERS for letter in o])).alias("letters")
    valued = merged.select("part", "grid", letters).select("part", "grid", F.expr(SHAPLEY).alias("values"), F.expr(_array(ORDERS)).alias("orders"))
    at = valued.select("part", "values", "orders", F.posexplode("grid").alias("at", "own"))
    order, step = F.expr("element_at(orders, cast(at div 5 AS int) + 1)"), F.expr("cast(at % 5 + 1 AS int)")
    rows = at.select("part", order.alias("filter_order"), step.alias("step"), "own.*", "values")
    return rows.withColumn("shapley", F.expr("element_at(values, ascii(substring(filter_order, step, 1)) - 64)")).drop("values")


SQL = r"""
WITH RECURSIVE letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders(o) AS (SELECT l FROM letters UNION ALL SELECT o || l FROM orders, letters WHERE NOT contains(o, l)),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e
  FROM texts),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
         || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
steps AS (
  SELECT part, o, k, substr(o, k, 1) AS l, n, good, toxic, fails, contains(fails, substr(o, k, 1)) AS failing,
         len(list_filter(string_split(substr(o, 1, k - 1), ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM cells, (SELECT o FROM orders WHERE length(o) = 5), (SELECT unnest(range(1, 6)) AS k)),
summed AS (
  SELECT part, o, k, l,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = l), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS toxic_lost
  FROM steps GROUP BY part, o, k, l)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM summed
"""

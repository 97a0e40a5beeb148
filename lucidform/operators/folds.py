"""Reproducible row splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidform.operators.ranking import _join_keys, hash_order, levels_for, row_numbers, source_bytes
from lucidform.operators.screening import _shuffles_released
from lucidform.session import written
from lucidform.sources.labelled import Labelled

FEW_REPEATS = 8  # so many repeats are placed by moving narrow rows once for each, more by their identities
NARROW = 16  # columns of a narrow row
TURN = 4  # repeats that one turn places
TURN_BYTES = 1 << 29  # source bytes times repeats that are placed in one plan
SORT_BYTES = 8 << 20  # source bytes whose rows one task orders: a row in memory takes some ten times its place in a file


def fold_starts(df: DataFrame, repeats: int, seed: int = 42, label: str = "y", rid: str = "rid") -> DataFrame:
    """(rid, label, starts): for each repeat, the place of a row identity among those of its class in digest order.

    Only identities move, once for all repeats: digests are sorted inside buckets of their leading digits, whose offsets
    come from a table of counts.  Rows with the same identity and class take consecutive places.
    """
    own = df.groupBy(F.coalesce(F.col(rid), F.lit("")).alias("rid"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("copies"))
    d = own.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = hash_order(seed, F.concat_ws("/", F.col("repeat"), F.col("rid")))
    placed = row_numbers(d, ["repeat", "label"], order, "place", weight="copies", small_keys=repeats <= FEW_REPEATS)
    starts = F.sort_array(F.collect_list(F.struct("repeat", "place")))  # one entry a repeat
    return placed.groupBy("rid", "label").agg(F.transform(starts, lambda s: s["place"]).alias("starts"))


def _with_starts(df: DataFrame, repeats: int, seed: int, label: str, rid: str) -> tuple[DataFrame, Column]:
    """Rows with their identity's starts, and the 0-based place of a row from a start: rows move once."""
    starts = fold_starts(df, repeats, seed, label, rid).withColumnRenamed("rid", "_rid").withColumnRenamed("label", "_label")
    rows = df.withColumn("_rid", F.coalesce(F.col(rid), F.lit(""))).withColumn("_label", F.col(label))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_rid", "_label").orderBy("_rid")))
    return rows.join(starts, ["_rid", "_label"]).drop("_rid", "_label"), F.col("_copy") - 2


def _placed(df: DataFrame, repeats: Iterable[int], seed: int, label: str, rid: str) -> DataFrame:
    """Rows with ``_place_r``, the 1-based place among those of their class in digest order, for each repeat.

    Rows move once a repeat, to the bucket of their digest's leading digits, and nothing else does: no identities, no
    digests, no way back.  Bucket offsets come from counts of the source.  As in ``fold_starts``, rows without a class have no place.
    """
    digits = max(3, -(-levels_for(df) // 4))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, source_bytes(df) // SORT_BYTES)
    digest = lambda r: hash_order(seed, F.concat_ws("/", r, F.coalesce(F.col(rid), F.lit(""))))
    rows = classes = df.where(F.col(label).isNotNull())
    for r in repeats:
        bucket = F.substring(digest(F.lit(r)), 1, digits).alias("_b")
        before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sizes = classes.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("_c"))
        heads = sizes.select(label, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
        moved = rows.select("*", bucket).repartition(parts, label, "_b")
        inside = Window.partitionBy(label, "_b").orderBy("_h")
        moved = moved.withColumn("_h", F.unhex(digest(F.lit(r)))).withColumn("_n", F.row_number().over(inside)).drop("_h")
        # at most classes x 16**digits offsets
        placed = _join_keys(moved, heads, [label, "_b"], True)
        rows = placed.withColumn(f"_place_{r}", F.col("_off") + F.col("_n")).drop("_b", "_n", "_off")
    return rows


def _in_turns(df: DataFrame, k: int, repeats: int, seed: int, label: str, rid: str) -> DataFrame:
    """Rows with ``_folds``, a fold number for each repeat, placed a few repeats at a time.

    What stays of a turn are the rows with their numbers so far; its shuffle files go when it ends, so that the disk held
    at once is that of a turn.
    """
    rows = df.withColumn("_folds", F.array().cast("array<int>"))
    with _shuffles_released(df.sparkSession):
        for first in range(0, repeats, TURN):
            turn = range(first, min(repeats, first + TURN))
            more = F.array(*[F.pmod(F.col(f"_place_{r}") - 1, F.lit(k)).cast("int") for r in turn])
            rows = written(_placed(rows, turn, seed, label, rid).withColumn("_folds", F.concat("_folds", more)).select(*rows.columns), "folds")
    return rows


def stratified_folds(df: DataFrame, k: int, repeats: int = 1, seed: int = 42, label: str = "y", rid: str = "rid") -> DataFrame:
    """Rows times repeats with a fold number; class sizes of folds differ by at most one.

    Rows of a class are numbered in digest order by many tasks, never by one; rows are repeated only after the last
    shuffle.  Many repeats of a large source are placed a few at a time.
    """
    if repeats > FEW_REPEATS and source_bytes(df) * repeats > TURN_BYTES:
        rows = _in_turns(df, k, repeats, seed, label, rid)
        return rows.select(*df.columns, F.posexplode("_folds").alias("repeat", "fold"))
    d, offset = _with_starts(df, repeats, seed, label, rid)
    long = d.select(*df.columns, "_copy", F.posexplode("starts").alias("repeat", "_start"))
    return long.withColumn("fold", F.pmod(F.col("_start") + offset, F.lit(k)).cast("int")).drop("_copy", "_start")


def with_fold_columns(lab: Labelled, k: int, repeats: int = 1, seed: int = 42) -> tuple[Labelled, list[str]]:
    """One group column per repeat holding ``repeat * k + fold``, next to the row."""
    d, offset = _with_starts(lab.df, repeats, seed, lab.label, lab.rid)
    cols = {f"fold_{r}": (F.lit(r * k) + F.pmod(F.col("starts")[r] + offset, F.lit(k))).cast("int") for r in range(repeats)}
    return lab.with_df(d.withColumns(cols).drop("_copy", "starts")), list(cols)


def with_fold_array(lab: Labelled, k: int, repeats: int = 1, seed: int = 42, out: str = "folds") -> Labelled:
    """One array column with ``repeat * k + fold`` for each repeat: a plan of the same width for any number of repeats
    beyond a few."""
    if repeats == 1 or (repeats <= FEW_REPEATS and len(lab.df.columns) <= NARROW):
        places = [f"_place_{r}" for r in range(repeats)]
        number = F.array(*[(F.lit(r * k) + F.pmod(F.col(p) - 1, F.lit(k))).cast("int") for r, p in enumerate(places)])
        return lab.with_df(_placed(lab.df, range(repeats), seed, lab.label, lab.rid).withColumn(out, number).drop(*places))
    d, offset = _with_starts(lab.df, repeats, seed, lab.label, lab.rid)
    number = F.transform("starts", lambda start, r: (r * k + F.pmod(start + offset, F.lit(k))).cast("int"))
    return lab.with_df(d.withColumn(out, number).drop("_copy", "starts"))


def fold_split(assigned: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    return assigned.where(F.col("fold") != fold), assigned.where(F.col("fold") == fold)


def holdout(df: DataFrame, fraction: float, seed: int = 42, rid: str = "rid", least: int = 20) -> DataFrame:
    """``held``: a digest-based share of the rows; if that would hold back fewer than
    ``least``, the share that holds about so many."""
    from lucidform.sources.grids import uniform

    rows = df.count()
    if fraction * rows < least:
        fraction = min(1.0, least / max(1, rows))
    return df.withColumn("held", uniform(seed, F.col(rid)) < fraction)


def sample_per_stratum(df: DataFrame, keys: list[str], n: int, seed: int = 42, rid: str = "rid") -> DataFrame:
    """At most n rows per stratum in digest order."""
    return row_numbers(df, keys, hash_order(seed, rid), "_rn").where(F.col("_rn") <= n).drop("_rn")


def every_kth(df: DataFrame, step: int, seed: int = 42, rid: str = "rid") -> DataFrame:
    """Evenly strided rows in digest order."""
    return row_numbers(df, [], hash_order(seed, rid), "_rn").where(F.pmod(F.col("_rn") - 1, F.lit(step)) == 0).drop("_rn")


def sample_n(df: DataFrame, n: int, seed: int = 42, rid: str = "rid") -> DataFrame:
    """The n rows with the smallest digests."""
    return df.withColumn("_h", hash_order(seed, rid)).orderBy("_h").limit(n).drop("_h")

"""Largest inner products by multi-probe p-stable hashing.

Vectors get one more component that makes all norms equal, so that the largest inner product is the least distance.
A table hashes by K random (2-stable) projections cut into cells; K follows from the number of vectors, but is held
at what ``CELLS`` cells can cover (buckets are larger then, and lie in more blocks).  A query
visits the cells around its own in the order of their estimated chance to hold a neighbour at the distance that
neighbours have (measured for a few queries against all vectors), until the chances of a table add up to ``REACH``.
Candidates of a table's buckets are scored exactly where the buckets lie; tables are merged by query.

Buckets are dealt to slots of some thousand vectors, large ones in blocks over several slots, so that a task scores
its part of the queries against its part of the vectors as matrices.  A query carries a floor: the score of a few
best among a fixed sample of vectors, below which nothing can be among its nearest.  Queries that are left with too
few finds are scored against all vectors, in blocks.

Vectors of one length are searched among each other.  Their norms are split into ranges of a factor of two, each with
tables of its own, so that a few long vectors don't squeeze all others into one cell; a query skips ranges that its
floor rules out.  A length that few vectors have is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidform.llm.common import FEW_IDS, by_group, cut
from lucidform.llm.vectors import as_bytes, classes, held_as, matrix, usable

NEAREST = 20
TABLES, REACH = 3, 0.62
#: Width of a cell as a share of the norm: about 2 bits a projection.
WIDTH = 1.1
#: Vectors of a bucket on the average, of a slot, and queries of a block.
BUCKET, SLOT, QUERIES = 512, 2048, 4096
#: Vectors sampled for the floor; queries sampled for the distance of neighbours; cells a query considers in a table.
FLOOR_SAMPLE, DISTANCE_SAMPLE, CELLS = 2048, 64, 4096
#: Vectors that a query's floor should leave, about.
LEFT = 80
#: Norm ranges; the last holds all smaller norms.
RANGES = 12
#: Vectors of a length up to which they are scored whole, as one group; queries scored against all vectors at once.
WHOLE, BLOCK = 2048, 4096
BINS = 2000


class Hashing(NamedTuple):
    dims: int
    norm: float
    cells: int
    distance: float
    seed: int = 23


@cache
def projections(h: Hashing, table: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions, offsets and cell width of a table."""
    rng = np.random.default_rng([h.seed, table, h.dims])
    width = WIDTH * h.norm
    return rng.standard_normal((h.dims + 1, h.cells)), rng.uniform(0, width, h.cells), width


def lifted(h: Hashing, x: np.ndarray, query: bool) -> np.ndarray:
    """Queries get unit norm times the largest norm and a last component of 0; vectors what is missing to that norm."""
    square = (x * x).sum(1)
    if query:
        return np.hstack([x * (h.norm / np.sqrt(square))[:, None], np.zeros((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(h.norm**2 - square, 0))[:, None]])


def cell_number(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of all projections."""
    out = np.zeros(cells.shape[:-1], dtype=np.uint64)
    for k in range(cells.shape[-1]):
        out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bucket(h: Hashing, x: np.ndarray, table: int) -> np.ndarray:
    a, b, width = projections(h, table)
    return cell_number(np.floor((lifted(h, x, False) @ a + b) / width))


def probes(h: Hashing, x: np.ndarray, table: int, reach: float = REACH, most: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): each query's buckets of a table, likeliest first, until their chances add up to ``reach``.

    A neighbour's projection lies around the query's with the distance as deviation; the chance of a cell is the
    product over projections.  The best cells of all projections are extensions of the best cells of the first ones,
    so lists of ``most`` partial cells are enough; queries for which these hold less chance than ``reach`` get longer
    lists, up to all cells.
    """
    row, number, short = _probes(h, x, table, reach, most)
    if not len(short):
        return row, number
    keep = ~np.isin(row, short)
    again, more = probes(h, x[short], table, reach, 4 * most)
    return np.concatenate([row[keep], short[again]]), np.concatenate([number[keep], more])


def _probes(h: Hashing, x: np.ndarray, table: int, reach: float, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and buckets by lists of ``longest`` partial cells, and the rows that these fall short for."""
    a, b, width = projections(h, table)
    at = (lifted(h, x, True) @ a + b) / width
    home = np.floor(at)
    spread = h.distance / width
    far = max(3, int(np.ceil(2.5 * spread)))
    steps = np.arange(-far, far + 1)
    n, every = len(x), len(steps) ** a.shape[1]
    chance, cells = np.ones((n, 1)), np.zeros((n, 1, 0))
    for k in range(a.shape[1]):
        edge = np.concatenate([home[:, k, None] + steps, home[:, k, None] + steps[-1] + 1], axis=1)
        own = np.diff(_normal((edge - at[:, k, None]) / spread), axis=1)
        grown = (chance[:, :, None] * own[:, None, :]).reshape(n, -1)
        most = min(longest, grown.shape[1])
        best = np.argsort(-grown, axis=1, kind="stable")[:, :most]
        chance = np.take_along_axis(grown, best, 1)
        before = np.take_along_axis(cells, (best // len(steps))[:, :, None], 1)
        cells = np.concatenate([before, (home[:, k, None] + steps[best % len(steps)])[:, :, None]], axis=2)
    total = np.cumsum(chance, axis=1) - chance
    row, place = np.nonzero(total < reach)
    short = np.flatnonzero(chance.sum(1) < reach) if longest < every else np.zeros(0, dtype=np.int64)
    return row, cell_number(cells[row, place]), short


def projections_for(h: Hashing, x: np.ndarray, wanted: int) -> int:
    """The largest number of projections up to ``wanted`` at which CELLS cells reach REACH for most of the queries x."""
    for k in range(wanted, 0, -1):
        short = [len(_probes(h._replace(cells=k), x, t, REACH, CELLS)[2]) for t in range(TABLES)]
        if 10 * sum(short) <= TABLES * len(x):
            return k
    return 0


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (a published rational approximation)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


def _some(own: DataFrame, share: float, salt: int) -> DataFrame:
    return own.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def neighbour_distance(packed: DataFrame, asking: list[bytes], norm: float, kind: str, nearest: int) -> float:
    """The median distance at which the asking queries have their last neighbour, from counts of scores by bin over
    all vectors.  A task sends the bins that hold its own nearest."""
    wanted = matrix(asking, kind)
    wanted = wanted / np.linalg.norm(wanted, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(wanted), BINS), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                at = np.clip((1 - matrix(batch.column("vector").to_pylist(), kind) @ wanted.T / norm) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                for q in range(len(wanted)):
                    count[q] += np.bincount(at[:, q], minlength=BINS)
        top = (count > 0) & (np.cumsum(count, axis=1) - count < nearest + 1)
        q, b = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(count[q, b])], names=["q", "bin", "n"])

    rows = packed.select("vector").mapInArrow(run, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect()
    count = np.zeros((len(wanted), BINS))
    for r in rows:
        count[r["q"], r["bin"]] = r["n"]
    last = np.argmax(np.cumsum(count, axis=1) >= min(nearest + 1, count.sum(1).min()), axis=1)
    return float(np.median(np.sqrt(np.maximum(4 * (last + 1) / BINS, 1e-3))) * norm)


def norm_range(largest: float) -> Column:
    """Number of a vector's norm range below the largest norm."""
    return F.least(F.greatest(F.floor(F.log2(F.lit(largest) / F.col("norm")) + 1e-12), F.lit(0)), F.lit(RANGES - 1)).cast("int")


def _indexed(packed: DataFrame, ranges: dict[int, Hashing], kind: str) -> DataFrame:
    """(t, bucket, id, vector): a table's number holds the norm range and the table in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("range").to_numpy()
            for r in np.unique(own):
                part = batch.filter(pa.array(own == r))
                x = matrix(part.column("vector").to_pylist(), kind)
                for t in range(TABLES):
                    table = pa.array(np.full(len(x), TABLES * r + t, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([table, pa.array(bucket(ranges[int(r)], x, t)), part.column("id"), part.column("vector")], names=["t", "bucket", "id", "vector"])

    return packed.select("id", "vector", "range").mapInArrow(run, "t int, bucket bigint, id bigint, vector binary")


def _probed(asking: DataFrame, ranges: dict[int, Hashing], kind: str) -> DataFrame:
    """(t, bucket, id) of the buckets that each query visits.  No inner product exceeds the product of the norms, so
    a range that this bounds below the query's floor is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                every, ids, floor = matrix(batch.column("vector").to_pylist(), kind), batch.column("id").to_numpy(), batch.column("floor").to_numpy()
                for r, h in ranges.items():
                    near = np.linalg.norm(every, axis=1) * h.norm * (1 + 1e-9) >= floor
                    x, own = every[near], ids[near]
                    for t in range(TABLES if len(x) else 0):
                        row, number = probes(h, x, t)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), TABLES * r + t, dtype=np.int32)), pa.array(number), pa.array(own[row])], names=["t", "bucket", "id"])

    return asking.select("id", "vector", "floor").mapInArrow(run, "t int, bucket bigint, id bigint")


def floors(asking: DataFrame, sample: list[bytes], rank: int, kind: str) -> DataFrame:
    """Adds the score of the query's ``rank``-th best in the sample; without limit where the sample is smaller."""
    held = matrix(sample, kind) if rank <= len(sample) else None
    names = asking.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            if held is not None and batch.num_rows:
                floor = np.partition(matrix(batch.column("vector").to_pylist(), kind) @ held.T, -rank, axis=1)[:, -rank]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*names, "floor"])

    return asking.mapInArrow(run, "id bigint, vector binary, floor double")


def _score(rows: pa.RecordBatch, kind: str, nearest: int) -> list[tuple]:
    """(query, id, score) of a slot's candidates: those in probed buckets, at least the floor, the best of each query."""
    query = rows.column("query").to_numpy(zero_copy_only=False).astype(bool)
    if query.all() or not query.any():
        return []
    mine, asked = rows.filter(pa.array(~query)), rows.filter(pa.array(query))
    x, ids = matrix(mine.column("vector").to_pylist(), kind), mine.column("id").to_numpy()
    known, code = np.unique(np.asarray(mine.column("buckets").flatten()), return_inverse=True)
    out = []
    for lo in range(0, asked.num_rows, 256):
        part = asked.slice(lo, 256)
        flat, many = np.asarray(part.column("buckets").flatten()), np.asarray(pc.list_value_length(part.column("buckets")))
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        visited = np.zeros((part.num_rows, len(known)), dtype=bool)
        ok = known[at] == flat
        visited[np.repeat(np.arange(part.num_rows), many)[ok], at[ok]] = True
        scores = matrix(part.column("vector").to_pylist(), kind) @ x.T
        scores[~visited[:, code] | (scores < part.column("floor").to_numpy()[:, None])] = -np.inf
        if scores.shape[1] > nearest + 1:
            last = np.partition(scores, -nearest - 1, axis=1)[:, -nearest - 1]
            scores[scores < last[:, None]] = -np.inf
        q, c = np.nonzero(scores > -np.inf)
        out += zip(part.column("id").to_numpy()[q].tolist(), ids[c].tolist(), scores[q, c].tolist())
    return out


def _search(index: DataFrame, crowds: DataFrame, asking: DataFrame, ranges: dict[int, Hashing], vectors: int, queries: int, kind: str, nearest: int) -> DataFrame:
    """(query, id, score) over classes, each pair once.  A slot's vectors go to the query parts that visit it only."""
    slots, parts = max(1, -(-vectors // SLOT)), max(1, -(-queries // QUERIES))
    blocks = F.ceil(F.col("n") / SLOT).cast("int")
    slot = lambda b: F.pmod(F.xxhash64("t", "bucket", b), F.lit(slots)).cast("int")
    visits = _probed(asking, ranges, kind).join(crowds, ["t", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    visits = cut(visits.withColumn("slot", slot(F.col("block"))).groupBy("t", "slot", "id").agg(F.collect_set("bucket").alias("buckets")), "visits")
    visits = visits.withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(parts)).cast("int"))
    asked = visits.join(asking, "id").select("t", "slot", "part", F.lit(1).alias("query"), "id", "vector", "buckets", "floor")
    visited = visits.groupBy("t", "slot").agg(F.collect_set("part").alias("parts"))
    mine = index.join(crowds, ["t", "bucket"]).withColumn("slot", slot(F.pmod(F.xxhash64("id"), blocks).cast("int")))
    mine = mine.join(visited, ["t", "slot"]).withColumn("part", F.explode("parts"))
    mine = mine.select("t", "slot", "part", F.lit(0).alias("query"), "id", "vector", F.array("bucket").alias("buckets"), F.lit(float("-inf")).alias("floor"))
    found = by_group(mine.unionByName(asked), ["t", "slot", "part"], lambda _, rows: _score(rows, kind, nearest), "query bigint, id bigint, score double")
    return found.groupBy("query", "id").agg(F.max("score").alias("score"))


def exact_nearest(packed: DataFrame, asking: DataFrame, kind: str, nearest: int, block: int = BLOCK) -> DataFrame:
    """(query, id, score) of each query's best ``nearest`` + 1 classes, by scores against all vectors.

    A pass takes a block of queries, at most ``block`` vectors on the driver and in each task; a task sends its own best.
    """
    spark, schema, out = packed.sparkSession, "query bigint, id bigint, score double", None
    blocks = max(1, -(-asking.count() // block))
    split = asking.select("id", "vector", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).alias("block"))
    for k in range(blocks):
        rows = split.where(F.col("block") == k).collect()
        if not rows:
            continue
        ids, wanted = np.array([r["id"] for r in rows]), spark.sparkContext.broadcast(b"".join(bytes(r["vector"]) for r in rows))

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, wanted=wanted) -> Iterator[pa.RecordBatch]:
            q = np.frombuffer(wanted.value, dtype=kind).reshape(len(ids), -1).astype(np.float64)
            best, named = np.full((len(ids), nearest + 1), -np.inf), np.zeros((len(ids), nearest + 1), dtype=np.int64)
            for whole in batches:
                for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                    scores = np.hstack([best, q @ matrix(batch.column("vector").to_pylist(), kind).T])
                    who = np.hstack([named, np.tile(batch.column("id").to_numpy(), (len(ids), 1))])
                    top = np.argpartition(-scores, nearest, axis=1)[:, : nearest + 1]
                    best, named = np.take_along_axis(scores, top, 1), np.take_along_axis(who, top, 1)
            r, c = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(named[r, c]), pa.array(best[r, c])], names=["query", "id", "score"])

        found = cut(packed.select("id", "vector").mapInArrow(run, schema), "exact")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _whole_lengths(packed: DataFrame, askers: DataFrame, kind: str, nearest: int) -> DataFrame:
    """(query, id, score) for lengths that few vectors have: each length is one group, scored whole."""
    asking = packed.join(askers.select("id").distinct().withColumn("query", F.lit(1)), "id", "left")
    rows = asking.select("dims", "id", "vector", F.coalesce("query", F.lit(0)).alias("query"))

    def score(key: tuple, batch: pa.RecordBatch) -> list[tuple]:
        x, ids = matrix(batch.column("vector").to_pylist(), kind), batch.column("id").to_numpy()
        out = []
        for q in np.flatnonzero(batch.column("query").to_numpy()):
            s = x @ x[q]
            top = np.flatnonzero(s >= np.partition(s, -nearest - 1)[-nearest - 1]) if len(s) > nearest + 1 else np.arange(len(s))
            out += zip([int(ids[q])] * len(top), ids[top].tolist(), s[top].tolist())
        return out

    return by_group(rows, ["dims"], score, "query bigint, id bigint, score double")


def _found(packed: DataFrame, askers: DataFrame, kind: str, nearest: int) -> DataFrame:
    """(query, id, score) for the classes of one length."""
    stats = packed.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.min("dims").alias("dims")).head()
    vectors, norm = stats["n"], stats["norm"]
    packed = packed.withColumn("range", norm_range(norm))
    asking = packed.join(askers.select("id").distinct(), "id", "left_semi")
    queries = asking.count()
    if not queries:
        return packed.sparkSession.createDataFrame([], "query bigint, id bigint, score double")
    sample = [bytes(r["vector"]) for r in _some(packed, FLOOR_SAMPLE / vectors, 1).collect()]
    rank = max(4, -(-LEFT * len(sample) // vectors))
    measured = [bytes(r["vector"]) for r in _some(asking, DISTANCE_SAMPLE / queries, 2).collect()]
    ranges = {}
    for r in packed.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect():  # RANGES rows at most
        own = packed.where(F.col("range") == r["range"])
        distance = neighbour_distance(own, measured, r["norm"], kind, nearest) if measured else r["norm"]
        h = Hashing(stats["dims"], r["norm"], max(0, round(np.log2(max(1, r["n"] / BUCKET)) / 2)), distance)
        ranges[r["range"]] = h._replace(cells=projections_for(h, matrix(measured, kind), h.cells)) if measured else h
    index = cut(_indexed(packed, ranges, kind), "buckets", "none")
    crowds = cut(index.groupBy("t", "bucket").agg(F.count("*").alias("n")), "crowds")
    asking = cut(floors(asking.select("id", "vector"), sample, rank, kind), "asking", "none")
    found = cut(_search(index, crowds, asking, ranges, vectors, queries, kind, nearest), "found")
    enough = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(nearest + 1, vectors)).select(F.col("query").alias("id"))
    short = cut(asking.select("id", "vector").join(enough, "id", "left_anti"), "short", "none")
    if short.isEmpty():
        return found
    rest = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").select("query", "id", "score")
    return rest.unionByName(exact_nearest(packed, short, kind, nearest))


def _first_members(valid: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """(class, vec_id): the ``most`` smallest vec_ids of each class, in three rounds so that a class of very many
    members is never in one place."""
    rows = valid.join(own.where("members > 1").select("h1", "h2", F.col("id").alias("class")), ["h1", "h2"]).select("class", "vec_id")
    for fan in (64, 8, 1):
        w = Window.partitionBy("class", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(fan))).orderBy("vec_id")
        rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")
    return rows.unionByName(own.where("members = 1").select(F.col("id").alias("class"), F.col("id").alias("vec_id")))


def nearest_vectors(rows: DataFrame, asks: str = "vec_id % 20 = 0", nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asks``, its nearest other rows by inner product.

    Ties go to the smaller vec_id.  Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without a vec_id, neither ask nor are found; vectors of different lengths have no inner product.  Equal
    vectors are searched once, rows that repeat a vec_id are taken row by row.  A very long vector is one row of a
    slot.  Other columns are ignored; an empty table gives no rows.  The driver holds samples of FLOOR_SAMPLE and
    DISTANCE_SAMPLE vectors, about, and a row for each length that more than WHOLE vectors have.
    """
    kind = held_as(rows)
    valid = cut(usable(rows), "vectors")
    own = classes(valid).withColumn("norm", F.expr("sqrt(aggregate(embedding, 0D, (a, x) -> a + x * x))")).withColumn("dims", F.size("embedding"))
    lengths = cut(own.groupBy("dims").agg(F.count("*").alias("n")), "lengths")
    long = lengths.where(F.col("n") > WHOLE)
    marked = own.join(F.broadcast(long) if lengths.count() <= FEW_IDS else long, "dims", "left")
    packed = cut(as_bytes(marked.select("id", "embedding", "norm", "dims", F.col("n").isNotNull().alias("many")), kind), "packed-vectors", "none")
    askers = cut(valid.where(asks).join(own.select("h1", "h2", "id"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "id"), "askers")
    found = _whole_lengths(packed.where("NOT many"), askers, kind, nearest)
    for r in long.orderBy("dims").collect():
        found = found.unionByName(_found(packed.where(F.col("dims") == r["dims"]), askers, kind, nearest))
    found = cut(found, "all-found")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= nearest + 1)
    pairs = best.select("query", F.col("id").alias("class"), "score").join(_first_members(valid, own, nearest + 1), "class").join(askers.withColumnRenamed("id", "query"), "query")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.where("vec_id <> query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

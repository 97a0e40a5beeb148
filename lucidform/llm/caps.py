"""Near-equal vectors by spherical-cap filters of a structured random product code.

A code splits the space into blocks after a random rotation.  Each block has a few random short vectors; a filter is
one of them from each block, its direction their concatenation, and it takes the vectors of the cap around it: inner
product of at least ``cap``.  A vector's filters are list-decoded from the blocks' small tables of inner products,
without visiting the others.  Vectors that share a filter are compared exactly.

The cap is so high that a filter takes about ``CROWD`` unrelated vectors (by the measure of the cap on the sphere), and
there are so many filters that a vector passes about ``PASSED`` of each code; one that passes fewer takes its best
``PASSED``.  Codes are independent, so the shares of pairs at the threshold that share no filter of a code multiply:
each code's is measured with random pairs, and codes are added until the product is at most ``MISS``.  Where that
would take more than ``MOST`` codes (few dimensions), caps are widened.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import by_group, cut
from lucidform.llm.components import components
from lucidform.llm.vectors import VALID, as_bytes, by_length, classes, held_as, matrix, plain, usable

LEAST = 0.95
BLOCKS, PASSED, CROWD = 2, 4, 16
#: Share of pairs at the threshold without a common filter, at most; random pairs a code is measured with; codes at most
#: before caps are widened; below so many dimensions codewords aren't composed.
MISS, PAIRS, MOST, PLAIN = 2e-5, 1000, 32, 6
#: Members of a filter that meet in one group with those of another such block.
BLOCK = 192


class Code(NamedTuple):
    rotation: np.ndarray
    words: list[np.ndarray]
    cap: float


class Plan(NamedTuple):
    """How many codes, and the share of the sphere that a filter takes."""

    codes: int
    tail: float


def cap_measure(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles up to a right one, and the share of the sphere within them."""
    angle = np.concatenate([[0], np.geomspace(1e-6, np.pi / 2, 20_001)])
    density = np.sin(angle) ** (dims - 2)
    measure = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(angle))])
    return angle, measure / (2 * measure[-1])


def cap_for(dims: int, tail: float) -> float:
    """The inner product with a fixed direction that a share ``tail`` of the sphere reaches."""
    if dims == 1:
        return 1 - 1e-9
    angle, measure = cap_measure(dims)
    return float(np.cos(np.interp(tail, measure, angle)))


@cache
def plan_for(dims: int, vectors: int, least: float = LEAST) -> Plan:
    """Enough codes that pairs of cosine ``least`` miss each other with a chance of at most MISS.

    Caps of less than half the pair's angle never hold both, so they start at 0.8 of it.
    """
    rng = np.random.default_rng([7, dims])
    x, z = rng.standard_normal((2, PAIRS, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dims > 1:
        z -= (z * x).sum(1, keepdims=True) * x
        z *= np.sqrt(1 - least**2) / np.linalg.norm(z, axis=1, keepdims=True)
        y = least * x + z
    else:
        y = x
    tail = min(0.05, CROWD / max(1, vectors))
    tail = max(tail, float(np.interp(0.8 * np.arccos(least), *cap_measure(dims)))) if dims > 1 else 0.5
    while True:
        left, codes = 1.0, 0
        while left > MISS and codes < MOST:
            code = product_code(dims, vectors, codes, tail)
            width = np.prod([len(w) for w in code.words])
            a, b = (row * width + number for row, number in (decode(code, v, PASSED) for v in (x, y)))
            met = len(np.unique(np.intersect1d(a, b) // width))
            left *= (PAIRS - met + 1) / (PAIRS + 1)
            codes += 1
        if left <= MISS or tail >= 0.5:
            return Plan(codes, tail)
        tail = min(0.5, 2 * tail)


def codes_for(dims: int, vectors: int, plan: Plan | None = None) -> list[Code]:
    return codes_of(dims, vectors, plan or plan_for(dims, vectors))


@cache
def codes_of(dims: int, vectors: int, plan: Plan) -> list[Code]:
    return [product_code(dims, vectors, k, plan.tail) for k in range(plan.codes)]


def product_code(dims: int, vectors: int, seed: int, tail: float | None = None) -> Code:
    """A code for so many vectors: the cap follows from CROWD or the given share, the number of codewords from PASSED."""
    rng = np.random.default_rng([seed, dims])
    tail = tail or min(0.05, CROWD / max(1, vectors))
    blocks = BLOCKS if dims >= PLAIN else 1
    size = max(2, int(np.ceil((PASSED / tail) ** (1 / blocks))))
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    words = []
    for part in np.array_split(np.arange(dims), blocks):
        w = rng.standard_normal((size, len(part)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(len(part) / dims))
    return Code(rotation, words, cap_for(dims, tail))


def decode(code: Code, unit: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All filters (row, filter number) whose direction has an inner product of at least the cap with a row.

    The best word of the later blocks bounds what a partial sum can still reach, so that only prefixes of passing
    filters are extended.  A row that passes fewer than ``least`` takes its ``least`` best.
    """
    turned = unit @ code.rotation
    at, scores = 0, []
    for w in code.words:
        scores.append(turned[:, at : at + w.shape[1]] @ w.T)
        at += w.shape[1]
    best = [s.max(1) for s in scores]
    top = np.zeros((len(unit), 1))
    for s in scores:
        own = -np.partition(-s, min(least, s.shape[1]) - 1, axis=1)[:, :least]
        top = (top[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
        top = -np.partition(-top, min(least, top.shape[1]) - 1, axis=1)[:, :least]
    limit = np.minimum(code.cap, top.min(1)) - 1e-12
    row, number, total = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
    for k, s in enumerate(scores):
        need = limit - sum(best[k + 1 :], np.zeros(len(unit)))
        reach = total[:, None] + s[row]
        i, j = np.nonzero(reach >= need[row][:, None])
        total, number, row = reach[i, j], number[i] * s.shape[1] + j, row[i]
    return row, number


def decode_all(codes: list[Code], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter number) over all codes."""
    each = [decode(c, unit, PASSED) for c in codes]
    return np.concatenate([r for r, _ in each]), np.concatenate([(k << 40) + n for k, (_, n) in enumerate(each)])


def passed(own: DataFrame, plans: dict[int, tuple[int, Plan]]) -> DataFrame:
    """(key, id) for every filter that a vector passes; vectors of different lengths have different keys.  ``plans``
    has the number of vectors and the plan of each length that two vectors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                ids = batch.column("id").to_numpy()
                for rows, x in by_length(batch.column("embedding")):
                    if x.shape[1] not in plans:
                        continue
                    row, number = decode_all(codes_for(x.shape[1], *plans[x.shape[1]]), x / np.linalg.norm(x, axis=1, keepdims=True))
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.full(len(row), x.shape[1], dtype=np.int32)), pa.array(ids[rows][row])], names=["key", "dims", "id"])

    return own.select("id", "embedding").mapInArrow(run, "key bigint, dims int, id bigint")


def _blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int")
    at = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return at.select("key", "dims", "id", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _links(key: tuple[int, int, int, int], rows: pa.RecordBatch, codes: list[Code], least: float, kind: str) -> list[tuple]:
    """Of a group, for each member with links that this filter is the first to see: how many vectors it links with,
    and a link towards the group's forest."""
    vectors = matrix(rows.column("vector").to_pylist(), kind)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    own, ids, many = (rows.column(c).to_numpy() for c in ("own", "id", "members"))
    near = np.triu(unit @ unit.T >= least, 1)
    if key[2] != key[3]:
        near &= own[:, None] != own[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return []
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    row, number = decode_all(codes, unit[used])
    early = number < key[0]
    _, number = np.unique(number[early], return_inverse=True)
    before = np.zeros((len(used), int(number.max(initial=0)) + 1), dtype=np.float32)
    before[row[early], number] = 1
    first = (before @ before.T) == 0
    keep = first[place[: len(i)], place[len(i) :]]
    i, j = i[keep], j[keep]
    n = np.bincount(i, many[j], len(ids)) + np.bincount(j, many[i], len(ids))
    root = np.arange(len(ids))
    for a, b in zip(i.tolist(), j.tolist()):
        if root[a] != root[b]:
            root[root == root[b]] = root[a]
    return [(int(ids[k]), int(n[k]), int(ids[root[k]])) for k in np.flatnonzero(n)]


def near_vectors(rows: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a
    null vec_id.  Equal vectors are compared once and linked with each other; their number counts in n_links.
    Vectors of different lengths aren't compared.  Other columns are ignored.
    """
    kind = held_as(rows)
    valid = cut(usable(rows), "vectors")
    own = classes(valid)
    counts = own.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).where("n > 1").collect()
    plans = {r["dims"]: (r["n"], plan_for(r["dims"], r["n"], least)) for r in counts}
    keyed = cut(passed(own, plans), "filters")
    several = cut(keyed.groupBy("key", "dims").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    grouped = _blocks(keyed.join(several, ["key", "dims"]), block).join(as_bytes(own.select("id", "members", "embedding"), kind), "id")

    def compare(key: tuple[int, int, int, int], rows: pa.RecordBatch) -> list[tuple]:
        return _links(key, rows, codes_for(key[1], *plans[key[1]]), least, kind)

    found = cut(by_group(grouped, ["key", "dims", "x", "y"], compare, "id bigint, n bigint, to bigint"), "vector-links")
    label = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    number = found.groupBy("id").agg(F.sum("n").alias("n"))
    told = own.select("h1", "h2", "id", "members").join(number, "id", "left").join(label, "id", "left")
    told = cut(told.select("h1", "h2", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-labels")
    linked = valid.select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = plain(rows).where(f"NOT ({VALID})").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

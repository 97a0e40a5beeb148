"""Best-two-fit packing of documents into sequences of a fixed length.

Pieces differ only by length for the packing, so it runs on a histogram of at most ``capacity`` lengths: a bin is
filled greedily with the longest piece that still fits; then its smallest piece gives way to two unpacked pieces
that fill the widened gap more tightly.  A bin of the same make is repeated as long as its lengths last, which gives
the bins of packing piece by piece.  The histogram and the bin makes are bounded by the capacity, not by the data;
pieces are dealt to bins by their rank among equals, counted in Spark.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucidform.llm.common import bounded_batches, chunks, cut
from lucidform.llm.tokens import encoder, tokenizer_path, with_end
from lucidform.llm.words import ragged

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part bigint, nth bigint"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Token pieces of whole texts: (doc_id, piece, start, length, ids, part, nth).

    Every document gets ``end_id`` after its ids; null and empty texts are the end id alone.  Documents longer than
    ``capacity`` are cut into pieces of it, the last may be shorter.  ``ids`` holds little-endian unsigned integers of
    2 bytes, or 4 for vocabularies over 65,536.  ``nth`` counts equal lengths within ``part``.  The table is written
    once, so that parts and counts stay as they are when a task is repeated.  Columns of other names are ignored;
    rows with the same doc_id are packed each for itself.
    """
    path = vocabulary or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in chunks(batches, "text"):
            ids, counts = with_end(*enc.encode(batch.column("text")), end_id)
            pieces = -(-counts // capacity)
            piece = ragged(np.zeros(len(pieces), dtype=np.int64), pieces).astype(np.int64)
            length = np.minimum(np.repeat(counts, pieces) - piece * capacity, capacity)
            order = np.argsort(length, kind="stable")
            sizes, first, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(first, many) + seen[length[order]]
            seen[sizes] += many
            data = ids.astype(f"<u{enc.width}").tobytes()
            bounds = np.concatenate([[0], np.cumsum(length)]) * enc.width
            payload = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(pieces)), pieces))), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), payload, pa.array(np.full(len(length), part)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids", "part", "nth"],
            )

    bounded_batches(docs)
    return cut(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES), "pieces")


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (piece lengths, how many bins of this make).  Every piece is placed; no bin exceeds the capacity."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[size] = n
    sizes = np.arange(capacity + 1)
    makes: list[tuple[list[int], int]] = []
    while left.any():
        below = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # longest left of at most this length
        taken: Counter[int] = Counter()
        held, gap = [], capacity
        while gap and (size := int(below[gap])):
            n = min(gap // size, int(left[size]) - taken[size])
            if n == 0:  # those left are all in this bin
                size = int(below[size - 1])
                while size and left[size] == taken[size]:
                    size = int(below[size - 1])
                if not size:
                    break
                n = min(gap // size, int(left[size]) - taken[size])
            held += [size] * n
            taken[size] += n
            gap -= size * n
        if gap and len(held) > 1:
            small = held[-1]
            pair = _pair(left, taken, small, gap + small)
            if pair:
                held[-1:] = pair
                taken = Counter(held)
        times = min(int(left[size]) // n for size, n in taken.items())
        for size, n in taken.items():
            left[size] -= n * times
        makes.append((held, times))
    return makes


def _pair(left: np.ndarray, taken: Counter[int], small: int, room: int) -> list[int] | None:
    """The two unpacked pieces that fill ``room`` best, if they do so better than the piece they replace."""
    free = left.copy()
    for size, n in taken.items():
        free[size] -= n
    free[small] += 1
    sizes = np.flatnonzero(free[: room + 1] > 0)
    sizes = sizes[sizes > 0]
    below = np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))
    other = below[np.minimum(sizes, room - sizes)]
    alone = (other == sizes) & (free[sizes] < 2)
    other = np.where(alone, below[np.maximum(np.minimum(sizes - 1, room - sizes), 0)], other)
    both = np.where(other > 0, sizes + other, 0)
    if not len(both) or both.max() <= small:
        return None
    k = int(both.argmax())
    return [int(sizes[k]), int(other[k])]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have (length, part, nth); other columns are kept."""
    counts = pieces.groupBy("length", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = cut(counts.select("length", "part", before.alias("before"), "count"), "piece-counts")
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs, base = [], 0
    used: Counter[int] = Counter()
    for held, times in best_two_fit(histogram, capacity):
        at = 0
        for size, n in sorted(Counter(held).items()):
            runs.append((size, used[size], n, base, at))
            used[size] += n * times
            at += size * n
        base += times
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]
    kept = pieces.columns

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, (size << 44) + rank, side="right") - 1]
            step = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(run[:, 3] + step // run[:, 2]), pa.array(run[:, 4] + step % run[:, 2] * size)],
                names=[*kept, "sequence_id", "offset"],
            )

    ranked = pieces.join(firsts.drop("count"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before")).select(*kept, "rank")
    return ranked.mapInArrow(lookup, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id bigint, offset bigint"]))


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences for training: (sequence_id, length, ids, doc_ids), at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return grouped.select("sequence_id", "length", F.expr("aggregate(transform(parts, x -> x.ids), X'', (a, b) -> concat(a, b))").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def with_crc(pieces: DataFrame, width: int = 2) -> DataFrame:
    """The crc32 of the ids as little-endian unsigned 32-bit integers in place of the ids."""
    kept = [c for c in pieces.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(b, dtype=f"<u{width}").astype("<u4").tobytes()) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])

    return pieces.mapInArrow(run, ", ".join([*(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept), "ids_crc32 bigint"]))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    placed = place(with_crc(token_pieces(docs)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Tables of vectors: validity, classes of equal vectors, and Arrow to numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lucidform.llm.common import bounded_batches, cut

FINITE = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
NONZERO = "exists(embedding, x -> x <> 0)"
VALID = f"vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce({FINITE} AND {NONZERO}, false)"


def plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, h1, h2) of vectors that aren't null, empty or zero and have only finite components; h1 and
    h2 are hashes of the components."""
    return plain(rows).where(VALID).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))


def classes(rows: DataFrame) -> DataFrame:
    """(h1, h2, id, members, embedding): one row for each distinct usable vector; id is its smallest vec_id."""
    own = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("members"), F.first("embedding").alias("embedding"))
    return cut(own, "vector-classes")


def held_as(rows: DataFrame) -> str:
    """Bytes that hold the table's components exactly."""
    kind = rows.schema["embedding"].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def matrix(rows: list[bytes], kind: str) -> np.ndarray:
    """Equal-length vectors held as bytes, in double precision."""
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)


def as_bytes(rows: DataFrame, kind: str) -> DataFrame:
    """The column ``embedding`` as bytes, which pass to tasks and through shuffles as they are."""
    kept = [c for c in rows.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            bounds = column.offsets.to_numpy().astype(np.int64)
            bounds = (bounds - bounds[0]) * np.dtype(kind).itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.asarray(column.flatten()).astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), packed], names=[*kept, "vector"])

    bounded_batches(rows)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "vector binary"]))


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column and their matrix, for each length that occurs."""
    bounds = column.offsets.to_numpy()
    flat = np.asarray(column.values)[bounds[0] : bounds[-1]]
    lengths = np.diff(bounds)
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        at = (bounds[rows] - bounds[0])[:, None] + np.arange(n)
        out.append((rows, flat[at]))
    return out

"""Written intermediates, shared files and small helpers of the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidform.session import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors, ends the lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that may be broadcast: some 16 bytes each.
FEW_IDS = 1_000_000


def few_ids(ids: DataFrame) -> DataFrame:
    """A written column of ids with a broadcast hint if they are few; beyond that Spark joins by shuffle."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a shared path, for files that Spark's writers have no format for."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)


#: Rows and bytes of an Arrow batch between Spark and its Python workers at most.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's limits for Arrow batches: texts are long, and a batch is held on both sides."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Give freed memory back: a worker is kept between tasks, and what it holds is counted beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes in a text column; one longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        lo = size = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += n
        if len(lengths) > lo:
            yield batch.slice(lo)
        release()



def by_group(df: DataFrame, keys: Sequence[str], fn: Callable[[tuple, pa.RecordBatch], list[tuple] | None], schema: str) -> DataFrame:
    """Rows of ``fn(key, rows of the key)`` for every key of whole numbers.

    For very many small groups: a task walks its sorted rows and holds one group at a time.
    """
    bounded_batches(df)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], []
        for got in batches:
            if not got.num_rows:
                continue
            cols = [got.column(k).to_numpy(zero_copy_only=False) for k in keys]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), got.num_rows]):
                key = tuple(int(c[lo]) for c in cols)
                if held and key != now:
                    rows += fn(now, join(held)) or []
                    held = []
                now = key
                held.append(got.slice(lo, hi - lo))
            if len(rows) > 20_000:
                yield batch(rows)
                rows = []
        if held:
            rows += fn(now, join(held)) or []
        if rows:
            yield batch(rows)
        release()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

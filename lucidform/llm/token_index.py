"""Token-id shards with keyed access through a minimal perfect hash index.

A shard holds the raw ids of a run of documents in ascending doc_id order, then a directory of fixed-size entries:

    ids | keys int64[n] | key present uint8[n] | end of each document in ids, int64[n] | n int64, width int64, magic

An index part holds, for the keys that hash to it, levels of bit arrays (a key's place is the rank of its bit in the
first level where it stood alone) and per place a fingerprint of the key, the shard, the record in it and the number
of records with the key.  Access is one hash to the part, a few bits, one fingerprint and one read.

Files are named by attempt and only those of committed tasks are listed, so lost or repeated tasks do no harm.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import bounded_batches, chunks, cut, file_system, make_folder, shared_folder, shuffle_parts
from lucidform.llm.tokens import encoder, tokenizer_path, with_end

MAGIC = 0x3144524853444D4C
RECORDS = "doc_id bigint, shard bigint, record bigint, n_tokens bigint, path string"
#: Keys of an index part at most, about.
PART_KEYS = 1 << 16


class Shards(NamedTuple):
    """records: a row per document.  paths, counts, ids: by shard in order, the records and ids of each (a row per
    shard file on the driver: some hundred bytes for each input split)."""

    records: DataFrame
    paths: list[str]
    counts: np.ndarray
    ids: np.ndarray


class Index(NamedTuple):
    paths: dict[int, str]
    parts: int


def write_shards(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None, folder: str | None = None) -> Shards:
    """Encode whole texts and write the shards.  Null text: empty; every document gets ``end_id``.

    Documents stand by doc_id (null first), then by a hash of the text; repeated rows are all written.  Columns
    other than doc_id and text are ignored.  An empty table makes no shard.
    """
    spark = docs.sparkSession
    folder, path = folder or shared_folder(spark, "token-shards"), vocabulary or tokenizer_path()
    make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    splits = max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(splits, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(path), TaskContext.get().partitionId()
        target = f"{folder}/{shard:07d}-{uuid.uuid4().hex}.ids"
        fs, local = file_system(target)
        out, keys, present, ends, total, n = None, [], [], [], 0, 0
        for batch in chunks(batches, "text"):
            out = out or fs.open_output_stream(local)
            ids, counts = with_end(*enc.encode(batch.column("text")), end_id)
            out.write(ids.astype(f"<u{enc.width}").tobytes())
            key = batch.column("doc_id")
            keys.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            present.append(key.is_valid().to_numpy(zero_copy_only=False))
            ends.append(total + np.cumsum(counts))
            total += len(ids)
            yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(key), shard)), pa.array(np.arange(n, n + len(key))), pa.array(counts), pa.array([target] * len(key))], names=["doc_id", "shard", "record", "n_tokens", "path"])
            n += len(key)
        if out:
            for a, kind in ((keys, "<i8"), (present, "u1"), (ends, "<i8")):
                out.write(np.concatenate(a).astype(kind).tobytes())
            out.write(np.array([n, enc.width, MAGIC], dtype="<i8").tobytes())
            out.close()

    bounded_batches(docs)
    records = cut(ordered.mapInArrow(run, RECORDS), "token-records")
    made = records.groupBy("shard", "path").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids")).orderBy("shard").collect()
    return Shards(records, [r["path"] for r in made], np.array([r["n"] for r in made], dtype=np.int64), np.array([r["ids"] for r in made], dtype=np.int64))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of booleans over distinct keys, and the place of each key: 0 to n - 1, each once."""
    levels, places, at, rest = [], np.empty(len(keys), dtype=np.int64), 0, np.arange(len(keys))
    while len(rest):
        size = 2 * len(rest) + 1
        slot = (mix(keys[rest], len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        mine = alone[slot]
        places[rest[mine]] = at + np.cumsum(alone)[slot[mine]] - 1
        at += int(mine.sum())
        levels.append(alone)
        rest = rest[~mine]
    return levels, places


def find_places(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1 where no level has it; a key that isn't in the set may get any."""
    places, at, rest = np.full(len(keys), -1, dtype=np.int64), 0, np.arange(len(keys))
    for k, alone in enumerate(levels):
        slot = (mix(keys[rest], k + 1) % np.uint64(len(alone))).astype(np.int64)
        hit = alone[slot]
        rank = np.cumsum(alone)
        places[rest[hit]] = at + rank[slot[hit]] - 1
        at += int(rank[-1])
        rest = rest[~hit]
    return places


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0xF1A9) >> np.uint64(32)).astype(np.uint32)


def write_index(shards: Shards, folder: str | None = None) -> Index:
    """Index every document key.  A key that stands several times points at its first record and their number."""
    spark = shards.records.sparkSession
    folder = folder or shared_folder(spark, "token-index")
    make_folder(folder)
    keyed = shards.records.groupBy("doc_id").agg(F.min(F.struct("shard", "record")).alias("first"), F.count("*").alias("copies"))
    keyed = keyed.select(F.xxhash64("doc_id").alias("digest"), "first.shard", "first.record", "copies")
    parts = max(shuffle_parts(spark), -(-int(shards.counts.sum()) // PART_KEYS))
    order = {s: i for i, s in enumerate(sorted(_shard_number(p) for p in shards.paths))}

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        digests = pdf["digest"].to_numpy().view(np.uint64)
        levels, places = perfect_hash(digests)
        fields = {"fingerprint": fingerprints(digests), "shard": pdf["shard"].map(order).to_numpy(np.int64), "record": pdf["record"].to_numpy(), "copies": pdf["copies"].to_numpy()}
        held = {}
        for name, values in fields.items():
            held[name] = np.empty_like(values)
            held[name][places] = values
        buffer = io.BytesIO()
        np.savez(buffer, sizes=np.array([len(x) for x in levels]), bits=np.packbits(np.concatenate(levels)), **held)
        target = f"{folder}/{key[0]:07d}-{uuid.uuid4().hex}.mph"
        fs, local = file_system(target)
        with fs.open_output_stream(local) as out:
            out.write(buffer.getvalue())
        return pd.DataFrame({"part": [key[0]], "path": [target]})

    made = cut(keyed.groupBy(F.pmod("digest", F.lit(parts)).alias("part")).applyInPandas(build, "part bigint, path string"), "token-index-parts")
    return Index({r["part"]: r["path"] for r in made.collect()}, parts)


def _shard_number(path: str) -> int:
    return int(path.rpartition("/")[2].partition("-")[0])


def open_part(path: str) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    fs, local = file_system(path)
    with fs.open_input_stream(local) as f:
        held = dict(np.load(io.BytesIO(f.read())))
    sizes = held.pop("sizes")
    bits = np.unpackbits(held.pop("bits"), count=int(sizes.sum())).astype(bool)
    return np.split(bits, np.cumsum(sizes)[:-1]), held


def locate(keys: DataFrame, index: Index, shards: Shards) -> DataFrame:
    """Records of the keys in ``doc_id``: (doc_id, shard, record), a row for each copy; unknown keys give none.
    Repeated keys count once."""

    def look(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] not in index.paths:
            return pdf.iloc[:0].assign(shard=0, record=0, copies=0)[["doc_id", "shard", "record", "copies"]]
        levels, held = open_part(index.paths[key[0]])
        digests = pdf["digest"].to_numpy().view(np.uint64)
        places = find_places(levels, digests)
        known = places >= 0
        known[known] = held["fingerprint"][places[known]] == fingerprints(digests[known])
        at = places[known]
        return pd.DataFrame({"doc_id": pdf["doc_id"][known], "shard": held["shard"][at], "record": held["record"][at], "copies": held["copies"][at]})

    digest = keys.select("doc_id").distinct().withColumn("digest", F.xxhash64("doc_id"))
    found = digest.groupBy(F.pmod("digest", F.lit(index.parts)).alias("part")).applyInPandas(look, "doc_id bigint, shard bigint, record bigint, copies bigint")
    bases = np.cumsum(shards.counts) - shards.counts

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = bases[batch.column("shard").to_numpy()] + batch.column("record").to_numpy() + batch.column("copy").to_numpy()
            shard = np.searchsorted(bases, one, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shard), pa.array(one - bases[shard])], names=["doc_id", "shard", "record"])

    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return copies.mapInArrow(spread, "doc_id bigint, shard bigint, record bigint")


class ShardFile:
    """Random access to one shard."""

    def __init__(self, path: str):
        fs, local = file_system(path)
        self.file = fs.open_input_file(local)
        size = self.file.size()
        n, self.width, magic = np.frombuffer(self.file.read_at(24, size - 24), dtype="<i8")
        if magic != MAGIC:
            raise ValueError(f"no shard of token ids: {path}")
        entries = self.file.read_at(int(n) * 17, size - 24 - int(n) * 17)
        self.keys = np.frombuffer(entries, dtype="<i8", count=n)
        self.present = np.frombuffer(entries, dtype="u1", count=n, offset=8 * n).astype(bool)
        self.ends = np.frombuffer(entries, dtype="<i8", count=n, offset=9 * n)

    def start(self, record: int) -> int:
        return int(self.ends[record - 1]) if record else 0

    def ids(self, record: int) -> np.ndarray:
        at = self.start(record)
        raw = self.file.read_at((int(self.ends[record]) - at) * int(self.width), at * int(self.width))
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


def read_documents(where: DataFrame, shards: Shards) -> DataFrame:
    """Read located records: (doc_id, start, n_tokens, ids binary of 32-bit ids).  ``start`` counts the ids of all
    documents before in the whole set; doc_id comes from the shard's own directory."""
    paths, bases = shards.paths, np.cumsum(shards.ids) - shards.ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, None
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                out = []
                for s, r in zip(batch.column("shard").to_pylist(), batch.column("record").to_pylist()):
                    if s != number:
                        number, shard = s, ShardFile(paths[s])
                    ids = shard.ids(r)
                    out.append((int(shard.keys[r]) if shard.present[r] else None, int(bases[s]) + shard.start(r), len(ids), ids.tobytes()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    spread = where.repartitionByRange(max(1, len(paths)), "shard", "record").sortWithinPartitions("shard", "record")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def with_crc(read: DataFrame) -> DataFrame:
    """The unsigned crc32 of the ids in their place."""
    return read.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


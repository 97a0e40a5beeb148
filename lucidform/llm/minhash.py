"""MinHash near-duplicates: universal hash minima, banding, signature check, full sets, large-star / small-star.

1.  Each text becomes a set of five-word shingles (64-bit hashes), 192 minima of it under universal hash functions, of
    which one byte each is kept, and a 128-bit hash of its words.  Texts with equal words form a class, for which one
    document stands from then on.
2.  The 32 bands of six minima are bucket keys.  Buckets of one class are dropped.  Larger buckets are split into
    blocks, and every two blocks of a bucket meet in a group of their own, so that no task gets a whole hot bucket
    and no pair is written out.
3.  Within a group, signatures tell which members may have a link that this bucket is the first to see.
4.  For those the full sets are compared exactly, skipping pairs that are already connected in the group.  A group
    returns a forest: fewer links than members.
5.  Links become components; copies take their class's.

At the threshold of 0.85 a pair shares no band with probability 3e-7, at 0.80 (the least allowed) with 6e-5; the
signature check (0.65) is 5 standard deviations below 0.80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import bounded_batches, by_group, chunks, cut, few_ids
from lucidform.llm.components import components
from lucidform.llm.words import split_words

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 32, 6
#: Least share of agreeing minima for two sets to be compared in full.
LIKELY = 0.65
#: Members of a block; two blocks meet in a group.
BLOCK = 256

_RNG = np.random.default_rng(20240711)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all shingles, not made distinct; bounds of each text's; a 16-byte hash of each text's words.

    A text of fewer words is one shingle; without words it has none.
    """
    codes, distinct, bounds = split_words(texts, lower=True)
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(distinct))
    words = known[codes]
    n = np.diff(bounds)
    rolled = np.zeros(len(words), dtype=np.uint64)
    for j in range(SHINGLE):
        rolled[: max(0, len(words) - j)] += _mixed(words[j:] + _P[j]) * _P[j]
    own = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    keep = np.arange(len(words)) - np.repeat(bounds[:-1], n) < np.repeat(own, n)
    out = rolled[keep]
    ends = np.concatenate([[0], np.cumsum(own)])
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):  # the rolled value would reach into the next text
        out[ends[i]] = xxhash.xxh3_64_intdigest(words[bounds[i] : bounds[i + 1]].tobytes(), seed=int(n[i]))
    raw = words.tobytes()
    return _mixed(out), ends, [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def signatures(hashes: np.ndarray, bounds: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """One byte of each minimum under (a x + b) >> 32, for every text that has shingles."""
    keys = hashes & np.uint64(0xFFFFFFFF)
    rows = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, len(_A)), dtype=np.uint8)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(bounds[rows + 1], bounds[rows[lo]] + most, side="right")))
        part, starts = keys[bounds[rows[lo]] : bounds[rows[hi - 1] + 1]], bounds[rows[lo:hi]] - bounds[rows[lo]]
        room = np.empty_like(part)
        for k in range(len(_A)):
            np.multiply(part, _A[k], out=room)
            room += _B[k]
            least = np.minimum.reduceat(room, starts) >> np.uint64(32)
            out[rows[lo:hi], k] = (least * np.uint64(0x9E3779B1) >> np.uint64(24)) & np.uint64(0xFF)
        lo = hi
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, words, signature): ``words`` is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            hashes, bounds, words = shingle_hashes(batch.column("text"))
            sigs = signatures(hashes, bounds)
            n = [len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([w if k else None for w, k in zip(words, n)], pa.binary()), pa.array([s.tobytes() if k else None for s, k in zip(sigs, n)], pa.binary())],
                names=["doc_id", "n_shingles", "words", "signature"],
            )

    bounded_batches(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, words binary, signature binary")


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) integers: the number of the band and its six bytes."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.int64)
    key = np.arange(BANDS, dtype=np.int64)[None, :] << 48
    for j in range(ROWS):
        key = key | parts[:, :, j] << (8 * j)
    return key


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id) for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key bigint, id bigint")


def met(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of buckets (key, n, id) in groups (key, x, y): each block with itself and with every other."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    at = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return at.select("key", "id", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _likely(key: tuple[int, int, int], rows: pa.RecordBatch) -> list[tuple]:
    """Members that have a likely partner whose first shared bucket is this one."""
    sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
    own, ids, band = rows.column("own").to_numpy(), rows.column("id").to_numpy(), key[0] >> 48
    keys = sig.reshape(len(sig), BANDS, ROWS)[:, :band]
    hit = np.zeros(len(ids), dtype=bool)
    need = int(np.ceil(LIKELY * sig.shape[1]))
    for i in range(len(ids) - 1):
        ok = (sig[i + 1 :] == sig[i]).sum(1) >= need
        if key[1] != key[2]:
            ok &= own[i + 1 :] != own[i]
        if ok.any():
            ok[ok] = ~(keys[i + 1 :][ok] == keys[i]).all(2).any(1)
        if ok.any():
            hit[i] = True
            hit[i + 1 :] |= ok
    return [(*key, int(o), int(d)) for o, d in zip(own[hit], ids[hit])]


def forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links with 100 * shared >= percent * united that connect what such links connect; ``side`` not None: only
    between different sides."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    mark = np.zeros(int(code.max()) + 1, dtype=np.int32)
    root, links = np.arange(n), []
    for i in range(n - 1):
        open_ = root[i + 1 :] != root[i]
        if side is not None:
            open_ &= side[i + 1 :] != side[i]
        if not open_.any():
            continue
        mark[code[starts[i] : starts[i] + size[i]]] = 1
        shared = np.add.reduceat(mark[code[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[code[starts[i] : starts[i] + size[i]]] = 0
        good = open_ & (100 * shared >= percent * (size[i] + size[i + 1 :] - shared))
        for j in np.flatnonzero(good) + i + 1:
            if root[j] != root[i]:
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return links


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): the distinct 64-bit shingle hashes of whole texts, from rows (id, words, text).

    Only texts with the words that ``words`` is the hash of: another text under the same doc_id isn't the class's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            hashes, bounds, words = shingle_hashes(batch.column("text"))
            own = [i for i, w in enumerate(batch.column("words").to_pylist()) if w == words[i]]
            sets = [np.unique(hashes[bounds[i] : bounds[i + 1]]).tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own, pa.int64())), pa.array(sets, pa.binary())], names=["id", "shingles"])

    bounded_batches(docs)
    return docs.select("id", "words", "text").mapInArrow(run, "id bigint, shingles binary").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Null, empty and blank texts have no shingles and link with nothing.  Rows with a null doc_id link with nothing
    and have a null component; they are kept.  Rows that repeat a doc_id are taken row by row, each by its own text.
    Very long texts are read whole, one at a time.  Columns other than doc_id and text are ignored.  ``percent``
    should not be below 80: bands and check are laid out for it.
    """
    sketched = cut(sketch(docs), "sketches")
    usable = sketched.where("doc_id IS NOT NULL AND words IS NOT NULL")
    own = usable.groupBy("words").agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature"))
    classes = cut(own.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers are fixed as they are written
    banded = buckets(classes)
    several = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = met(banded.join(several, "key"), block)
    grouped = members.join(classes.select("id", "signature"), "id")

    likely = cut(by_group(grouped, ["key", "x", "y"], _likely, "key bigint, x int, y int, own int, id bigint"), "likely")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("first"), F.col("text").cast("string").alias("text"))
    wanted = few_ids(cut(classes.select("id", "first", "words").join(likely.select("id").distinct(), "id", "left_semi"), "wanted"))
    sets = full_sets(texts.join(wanted, "first"))

    def compare(key: tuple[int, int, int], rows: pa.RecordBatch) -> list[tuple]:
        side = rows.column("own").to_numpy() if key[1] != key[2] else None
        return forest(rows.column("id").to_numpy(), [np.frombuffer(b, dtype=np.uint64) for b in rows.column("shingles").to_pylist()], side, percent)

    links = by_group(likely.join(sets, "id"), ["key", "x", "y"], compare, "a bigint, b bigint")
    joined_classes = cut(classes.select("id", "first").join(components(links), "id"), "joined-classes")
    least = joined_classes.groupBy("component").agg(F.min("first").alias("least"))
    moved = joined_classes.join(least, "component").select("id", "least")
    labels = cut(classes.select("id", "words", "first").join(moved, "id", "left").select("words", F.coalesce("least", "first").alias("component")), "labels")
    own = F.when(F.col("words").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    joined = sketched.join(labels, "words", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stand for their groups, with all their columns.

    Of rows that repeat a doc_id and its text one stays; a doc_id that has a text of its own keeps all its texts.
    Rows with a null doc_id and rows without words all stay.  An empty table stays empty.
    """
    found = cut(near_duplicates(docs, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    dropped = cut(found.where(~F.col("kept")).select("doc_id"), "dropped")
    rest = docs.join(few_ids(dropped), "doc_id", "left_anti").select(*docs.columns)
    if found.where("n > 1 AND doc_id IS NOT NULL").isEmpty():
        return rest
    return rest.where("doc_id IS NULL").unionByName(rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))

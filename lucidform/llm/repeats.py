"""Substring dedup: words in passages of ``WINDOW`` words and more that stand earlier too are removed.

Every window of 20 words goes to the shard of its minimizer (the least hash of its 8-word runs), so equal windows meet
in one shard and no document visits any other.  Consecutive windows with one minimizer travel together as a segment.

1.  Minimizers are counted; one that stands once in the whole table can't have a repeated window.
2.  Segments of the others, equal ones added up to their first place: all later copies of a segment are repeats.
3.  Distinct segments that share a minimizer are built into a compressed FM-index per shard (``fmindex``) and streamed
    through it: backward search gives the matching statistics from the window length on, with the earliest place at
    which a match stands.
4.  A minimizer with more than ``CROWD`` distinct segments (a common passage in very many contexts) would make one
    shard grow with the table: its windows are dealt out by their own hash and added up to their first place.
5.  Matched runs become spans of documents, and spans are cut out of the texts.

Places are ordered by doc_id (null first, those by a hash of their text), then by the position of the window.  Words
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import bounded_batches, by_group, chunks, cut, shuffle_parts
from lucidform.llm.fmindex import FmIndex
from lucidform.llm.words import Words, ragged, split_words

WINDOW, GRAM = 20, 8
#: Words of a shard, about; distinct segments of a minimizer from which its windows are dealt out.
SHARD_WORDS, CROWD = 1 << 18, 2048

_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)
_STEPS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEPS[0]
    x = (x ^ (x >> np.uint64(29))) * _STEPS[1]
    return x ^ (x >> np.uint64(32))


def hashed(words: Words) -> np.ndarray:
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words.distinct))
    return known[words.codes]


class Rolled:
    """Hashes of any runs of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        power, self.back = (np.full(len(words) + 1, base, dtype=np.uint64) for base in (_B, _B_INVERSE))
        power[0] = self.back[0] = 1
        power, self.back = np.cumprod(power), np.cumprod(self.back)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(words) * power[:-1])])

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        n = np.asarray(length, dtype=np.uint64)
        return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start] + n * _STEPS[2])


def segments(rolled: Rolled, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimizer) of the runs of windows with one minimizer at one place, at most
    ``window - gram + 1`` windows each; positions count from the first word of all texts.  Equal windows of one text
    have their minimizers at different places, so no segment holds a window twice."""
    per = window - gram + 1
    own = np.maximum(np.diff(bounds) - window + 1, 0)
    total = int(bounds[-1])
    if not own.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    least = rolled.of(np.arange(total - gram + 1), gram)
    where, span = np.arange(len(least)), 1
    while span < per:  # the least of ``span`` runs from each position on, and its first place
        step = min(span, per - span)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    at = ragged(bounds[:-1], own)
    text = np.repeat(np.arange(len(own)), own)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (where[at[1:]] != where[at[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], at[first].astype(np.int64), np.diff(np.append(first, len(at))), least[at[first]].view(np.int64)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` is a hash of the text, so rows that repeat a doc_id are told apart."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounded_batches(docs)
    return rows.select("doc_id", F.xxhash64("text").alias("row"), "text")


def minimizer_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, n): segments by minimizer, added up in each slice of the input first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"))
            key, n = np.unique(segments(Rolled(hashed(words)), words.bounds, window, gram)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def listed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, seg, doc_id, row, start, windows) of all segments; ``seg`` is a hash of the segment's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"))
            rolled = Rolled(hashed(words))
            text, at, n, key = segments(rolled, words.bounds, window, gram)
            seg = rolled.of(at, n + window - 1).view(np.int64)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array((at - words.bounds[text]) << 8 | n)], names=["key", "seg", "doc_id", "row", "at"])

    return docs.mapInArrow(run, "key bigint, seg bigint, doc_id bigint, row bigint, at bigint")


def place(row: str = "row", start: str | Column = "start") -> Column:
    """The order of windows: doc_id, for null ids the text's hash, position."""
    return F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col(row)).alias("tie"), (F.col(start) if isinstance(start, str) else start).alias("start"))


def contents(docs: DataFrame, heads: DataFrame, window: int) -> DataFrame:
    """Words of the segments in ``heads``: (key, seg, hot, doc_id, tie, start, part, hash, words).

    A segment of a crowded minimizer (hot) gives a row for each window, without words; ``part`` is its offset.
    """
    wanted = heads.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "seg", "start", "windows", "hot")).alias("heads"))
    joined = docs.alias("d").join(wanted.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d.row = h.row")).select("d.doc_id", "d.row", "d.text", "h.heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"))
            hashes, asked = hashed(words), batch.column("heads")
            rolled = Rolled(hashes)
            text = pc.list_parent_indices(asked).to_numpy().astype(np.int64)
            flat = pc.list_flatten(asked)
            key, seg, start, n, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "seg", "start", "windows", "hot"))
            at = start + words.bounds[text]
            parts = np.where(hot, n, 1)
            row = np.repeat(np.arange(len(at)), parts)
            part = ragged(np.zeros(len(at), dtype=np.int64), parts).astype(np.int64)
            begin = at[row] + part
            length = np.where(hot[row], window, n[row] + window - 1)
            raw = hashes.tobytes()
            held = [None if h else raw[8 * a : 8 * (a + m)] for h, a, m in zip(hot[row].tolist(), begin.tolist(), length.tolist())]
            docs_at, rows_at = (batch.column(c).take(pa.array(text[row])) for c in ("doc_id", "row"))
            tie = pc.if_else(pc.is_null(docs_at), rows_at, pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[row]), pa.array(seg[row]), pa.array(hot[row]), docs_at, tie, pa.array(start[row] + part), pa.array(part), pa.array(rolled.of(begin, length).view(np.int64)), pa.array(held, pa.binary())],
                names=["key", "seg", "hot", "doc_id", "tie", "start", "part", "hash", "words"],
            )

    return joined.mapInArrow(run, "key bigint, seg bigint, hot boolean, doc_id bigint, tie bigint, start bigint, part bigint, hash bigint, words binary")


def places(rows: pa.RecordBatch) -> np.ndarray:
    """Numbers that order (doc_id, tie, start) of the rows, nulls first, with room for a segment's windows between."""
    cols = []
    for c in ("doc_id", "tie"):
        cols += [rows.column(c).is_valid().to_numpy(zero_copy_only=False), rows.column(c).fill_null(0).to_numpy()]
    order = np.lexsort(cols[::-1])
    change = np.zeros(len(order), dtype=bool)
    for c in cols:
        change[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(change)
    return (number << 36) + rows.column("start").to_numpy()


def earlier_windows(rows: pa.RecordBatch, window: int) -> list[tuple[int, int, int, int]]:
    """(key, seg, first window, windows) that stand earlier in the shard: its segments are indexed, then streamed."""
    lengths = pc.binary_length(rows.column("words")).to_numpy().astype(np.int64) // 8
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    _, symbols = np.unique(np.frombuffer(b"".join(rows.column("words").to_pylist()), dtype=np.uint64), return_inverse=True)
    place = np.repeat(places(rows) - bounds[:-1], lengths) + np.arange(bounds[-1])
    index = FmIndex(symbols + 1, bounds, place, window)
    found = index.match(symbols + 1, bounds)
    hit = (found >= 0) & (found < place)
    starts = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
    ends = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]])) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1  # a segment's last words open no window, so runs end with it
    key, seg = rows.column("key").to_numpy()[owner], rows.column("seg").to_numpy()[owner]
    return list(zip(key.tolist(), seg.tolist(), (starts - bounds[owner]).tolist(), (ends - starts).tolist()))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, row, spans): spans (start, length) of words, overlapping or not, that stand earlier too, for documents
    that have any.  ``row`` is the hash of the text (``named``).  Arguments other than ``window`` change no result."""
    spark, rows = docs.sparkSession, named(docs)
    repeated = cut(minimizer_counts(rows, window, gram).where("n > 1").select("key"), "repeated-minimizers")
    found = listed(rows, window, gram).join(repeated, "key")
    found = cut(found.select("key", "seg", "doc_id", "row", F.shiftright("at", 8).alias("start"), F.col("at").bitwiseAND(255).alias("windows")), "segments")
    first = F.min(F.struct(place().alias("place"), "row")).alias("first")
    distinct = cut(found.groupBy("key", "seg").agg(first, F.first("windows").alias("windows"), F.count("*").alias("n")), "distinct-segments")
    shared = cut(distinct.groupBy("key").agg(F.count("*").alias("segs")).where("segs > 1"), "shared-minimizers")
    heads = distinct.join(shared, "key").select("key", "seg", "first.place.doc_id", "first.row", "first.place.start", "windows", (F.col("segs") > crowd).alias("hot"))
    held = cut(contents(rows, heads, window), "segment-words", "none")

    cold = held.where("NOT hot")
    size = cold.agg(F.sum(F.length("words"))).head()[0] or 0
    shards = max(shuffle_parts(spark), -(-size // (8 * shard_words)))
    sharded = cold.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "seg", "doc_id", "tie", "start", "words")
    matched = by_group(sharded, ["shard"], lambda _, batch: earlier_windows(batch, window), "key bigint, seg bigint, part bigint, n bigint")
    crowded = held.where("hot").select("key", "seg", "part", "hash", F.struct("doc_id", "tie", "start").alias("place"))
    least = cut(crowded.groupBy("hash").agg(F.min("place").alias("least"), F.count("*").alias("n")).where("n > 1"), "crowded-windows")
    late = crowded.join(least, "hash").where("place > least").select("key", "seg", "part", F.lit(1).cast("bigint").alias("n"))
    runs = matched.unionByName(late).groupBy("key", "seg").agg(F.collect_list(F.struct("part", "n")).alias("runs"))

    known = cut(distinct.where("n > 1").select("key", "seg", F.col("first.place").alias("least")).join(runs, ["key", "seg"], "full"), "segment-runs")
    own = F.expr("transform(runs, r -> struct(start + r.part AS start, r.n AS n))")
    whole = F.array(F.struct("start", F.col("windows").alias("n")))
    spans = F.when(place() > F.col("least"), whole).otherwise(own)
    late = found.join(known, ["key", "seg"]).withColumn("span", F.explode(spans))
    length = (F.col("span.n") + (window - 1)).alias("length")
    return cut(late.select("doc_id", "row", F.struct(F.col("span.start").alias("start"), length).alias("span")).groupBy("doc_id", "row").agg(F.collect_list("span").alias("spans")), "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, **how: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of every document that stay, joined by single spaces.

    Null and blank texts have no words; texts shorter than a window keep all.  Very long texts are read whole, one at
    a time.  Rows equal in doc_id and text are one document and alike in the result; rows that only share a doc_id
    count as one document, in which the place of a window is its position in its own text.  Documents with a null
    doc_id stand before all others, by a hash of their text.  An empty table gives no rows; other columns are ignored.
    """
    rows = named(docs).alias("d")
    joined = rows.join(repeated_spans(docs, window, **how).alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.row = s.row"), "left").select("d.doc_id", "d.text", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"))
            spans = batch.column("spans")
            text = pc.list_parent_indices(spans).to_numpy().astype(np.int64)
            flat = pc.list_flatten(spans)
            begin = flat.field("start").to_numpy() + words.bounds[text]
            edges = np.zeros(len(words.codes) + 1, dtype=np.int64)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + flat.field("length").to_numpy(), -1)
            stay = np.cumsum(edges[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stay)])[words.bounds]
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.distinct.take(pa.array(words.codes[stay])))
            n = np.diff(words.bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(kept)), pc.binary_join(lists, " ")], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


#: The same in DuckDB's SQL, for tables whose doc_id is unique and not null.
SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM texts WHERE len(w) >= 20),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM windows),
late AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS late FROM hashed),
marked AS (
  SELECT w.doc_id, w.i, w.word, coalesce(max(CAST(l.late AS INT)) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words w LEFT JOIN late l ON w.doc_id = l.doc_id AND w.i = l.i),
kept AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS text FROM marked GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

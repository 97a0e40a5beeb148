"""Conversation structure repair: faults of turns, and the cheapest edits to alternating roles.

Turns are sorted by range over (conversation, turn), so a conversation of any length lies in as many partitions as it
needs, and are packed into chunk rows of bounded size.  Each chunk gets, by block tables (``edits``), the least costs
between states before and after it.  A fold over a conversation's chunks from the last to the first gives the costs of
what follows each; with these every chunk is traced on its own, for each state it may be entered in.  A last pass in
order picks the traces, and hashes the repaired text as it goes: only chunk rows meet there, one at a time.

Equal rows of a conversation are one row with a count; all but the first are duplicates, which are always deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.llm import edits
from lucidform.llm.common import bounded_batches, cut, release, shuffle_parts

SPACE = " \t\n\x0b\x0c\r"
#: Rows and bytes of text of a chunk at most; one longer text is in a chunk of its own.
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20

CHUNK = (
    "conv_id bigint, part int, chunk bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, head string, tail string, symbols binary, times array<bigint>, roles array<string>, texts array<string>, costs array<bigint>"
)
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1
    empties its text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes it the user's.  Nulls count as one space."""
    rows = plain(rows)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    at = rows.withColumn("fault", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return at.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("bigint").alias("times"))


def plain(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))


def told_apart(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number (times) and whether role and text are new in the conversation (fresh)."""
    own = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")
    several = own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = own.alias("o").join(several.alias("s"), F.expr("o.conv_id <=> s.conv_id AND o.role = s.role AND o.digest = s.digest"), "left")
    fresh = F.expr("s.n IS NULL OR o.turn <=> s.first.turn").alias("fresh")
    return joined.select("o.conv_id", "o.turn", "o.role", "o.text", "o.times", fresh)


def _pieces(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """(conversation, rows) of at most so many rows and bytes, in order."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        lo = size = 0
        for i, n in enumerate(sizes):
            if i > lo and (ids[i] != ids[lo] or i - lo >= most_rows or size + n > most_bytes):
                yield ids[lo], batch.slice(lo, i - lo)
                lo, size = i, 0
            size += n
        if len(ids) > lo:
            yield ids[lo], batch.slice(lo)


def _chunk(conv: int | None, rows: pa.RecordBatch) -> dict:
    """Counts and symbols of consecutive rows of one conversation."""
    trimmed = pc.utf8_rtrim(rows.column("text"), characters=SPACE)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    closed = pc.is_in(pc.utf8_slice_codeunits(trimmed, -1), pa.array([".", "!", "?"])).to_numpy(zero_copy_only=False)
    times, fresh = rows.column("times").to_numpy(), rows.column("fresh").to_numpy(zero_copy_only=False)
    must = blank | ~fresh
    initials = pc.utf8_slice_codeunits(rows.column("role"), 0, 1).to_pylist()
    kind = np.array([edits.ROLES.find(c) if c in ("s", "u", "a") else 3 for c in initials])
    symbols = np.where(must, 0, 1 + 2 * kind + ~closed).astype(np.uint8)
    turns = [t for t in rows.column("turn").to_pylist() if t is not None]
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    return {
        "conv_id": conv, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
        "blank": int(times[blank].sum()), "duplicate": int((times - fresh)[~blank].sum()), "truncated": int((~must & ~closed).sum()),
        "illegal": int((times - 1).sum()) + sum(illegal(a, b) for a, b in zip(initials, initials[1:])),
        "head": initials[0], "tail": initials[-1], "symbols": symbols.tobytes(), "times": times.tolist(),
        "roles": ["" if m else r for m, r in zip(must, roles)], "texts": ["" if m else t for m, t in zip(must, texts)],
    }


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def chunks_of(rows: DataFrame, most_rows: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all conversations, each with its 4 x 4 least costs."""
    order = ["conv_id", "turn", "role", "text"]
    rows = cut(rows, "fresh-turns")
    bounded_batches(rows)
    fields = [c.strip().split(" ", 1) for c in CHUNK.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def batch_of(held: list[dict]) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(c["symbols"]) for c in held])])
        costs = edits.matrices(np.frombuffer(b"".join(c["symbols"] for c in held), dtype=np.uint8), bounds)
        for c, m in zip(held, costs):
            dropped = 2 * (sum(c["times"]) - len(c["times"]))  # further copies of a row
            c["costs"] = np.where(m < 1 << 59, m + dropped, m).ravel().tolist()
        return pa.RecordBatch.from_pylist(held, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0
        for n, (conv, piece) in enumerate(_pieces(batches, most_rows, most_bytes)):
            held.append(_chunk(conv, piece) | {"part": part, "chunk": n})
            size += piece.nbytes
            if size > 2 * most_bytes or len(held) >= 1000:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)
        release()

    spread = rows.repartitionByRange(max(shuffle_parts(rows.sparkSession), rows.rdd.getNumPartitions()), *order).sortWithinPartitions(*order)
    return cut(spread.mapInArrow(run, CHUNK), "conversation-chunks")


def _folded(costs: list[int], after: list[int]) -> list[int]:
    return [min(costs[4 * q + x] + after[x] for x in range(4)) for q in range(4)]


def costs_after(chunks: DataFrame) -> DataFrame:
    """(part, chunk, total, after): least cost of the conversation from the chunk on, entered at the start, and the
    costs by state of what follows the chunk."""
    end = edits.tables().vectors[edits.tables().end].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after = object(), end
        for batch in batches:
            out = []
            for conv, part, chunk, costs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "chunk", "costs"))):
                if conv != now:
                    now, after = conv, end
                before = _folded(costs, after)
                low = min(after)
                out.append((part, chunk, before[0], [c - low for c in after]))
                after = before
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["part", "chunk", "total", "after"])

    rows = chunks.select("conv_id", "part", "chunk", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    return rows.mapInArrow(run, "part int, chunk bigint, total bigint, after array<bigint>")


def traced(chunks: DataFrame, after: DataFrame) -> DataFrame:
    """Chunks with their edits and the state after them, for each state before them."""
    joined = chunks.drop("costs").join(after, ["part", "chunk"])
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [[edits.trace(s, tuple(a), q) for q in range(4)] for s, a in zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist())]
            audits = pa.array([[w[0] for w in four] for four in ways], pa.list_(pa.string()))
            states = pa.array([[w[1] for w in four] for four in ways], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, audits, states], names=[*names, "audits", "states"])

    bounded_batches(chunks)
    kinds = ", ".join(f"{c} {t}" for c, t in joined.dtypes)
    return joined.mapInArrow(run, f"{kinds}, audits array<string>, states array<int>")


class _Conversation:
    """Results of one conversation, chunk by chunk."""

    def __init__(self, conv: int | None, total: int):
        self.conv, self.cost, self.state = conv, total, 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.tail = None
        self.audit: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def add(self, c: dict) -> None:
        for k in self.counts:
            self.counts[k] += c[k]
        if self.tail is not None:
            self.counts["illegal"] += illegal(self.tail, c["head"])
        self.tail = c["tail"]
        if c["low"] is not None:
            self.counts["turns"] -= c["low"] == self.high
            self.low, self.high = c["low"] if self.low is None else self.low, c["high"]
        state, i = self.state, 0
        for edit in c["audits"][state]:
            if edit in "IR":
                self.write(edits.ROLE[state], "" if edit == "I" else c["texts"][i])
                state = edits.AFTER[state]
            elif edit == "K":
                self.write(c["roles"][i], c["texts"][i])
                state = edits.KEPT[c["roles"][i][0]][state]
            self.audit.append(edit)
            if edit != "I":
                self.audit.append("D" * (c["times"][i] - 1))
                i += 1
        self.state = c["states"][self.state]

    def result(self) -> tuple:
        for edit in edits.last_edits(self.state):
            self.write(edits.ROLE[self.state], "")
            self.state = edits.AFTER[self.state]
            self.audit.append(edit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return (self.conv, gaps, *(self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), self.cost, "".join(self.audit), self.digest.hexdigest())


def repaired(rows: DataFrame, most_rows: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each conversation in (conv_id, turn, role, text[, times]): gaps, faults, illegal neighbours, least
    cost, the edits' initials and a hash of the repaired text.

    Turns stand by turn (null first), then by role and text.  Null role or text counts as one space; a null conv_id is
    a conversation of its own.  Equal rows are duplicates of the first.  Roles other than those with initials s, u or
    a can't be kept.  Very long texts and conversations are taken in chunks; a conversation's edits are one string.
    An empty table gives no rows; other columns are ignored.
    """
    own = plain(rows) if "times" not in rows.columns else rows.select("conv_id", "turn", "role", "text", "times")
    own = own if "times" in own.columns else own.withColumn("times", F.lit(1).cast("bigint"))
    chunks = chunks_of(told_apart(own), most_rows, most_bytes)
    ways = traced(chunks, costs_after(chunks)).drop("symbols", "after").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for c in batch.to_pylist():
                if now is None or now.conv != c["conv_id"]:
                    out += [now.result()] if now else []
                    now = _Conversation(c["conv_id"], c["total"])
                now.add(c)
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                out = []
        out += [now.result()] if now else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return ways.mapInArrow(run, RESULT)


def repaired_after_damage(rows: DataFrame) -> DataFrame:
    """``repaired`` after ``damaged``, for every conv_id of ``rows``; those without rows left have zeros."""
    found = cut(repaired(damaged(rows)), "repaired").alias("f")
    every = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().alias("e")
    joined = every.join(found, F.expr("e.conv_id <=> f.conv_id"), "left").select("e.conv_id", *(f"f.{c.split()[0]}" for c in RESULT.split(", ")[1:]))
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return joined.fillna({c.split()[0]: none.get(c.split()[0], 0) for c in RESULT.split(", ")[1:]})


#: The same in DuckDB's SQL: crc32 by its polynomial, then all states' least (cost, edits, text) turn by turn.
SQL = r"""
WITH RECURSIVE crc(b, k, c) AS (
  SELECT b, 0, b FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8),
lookup AS (SELECT list(c ORDER BY b) AS l FROM crc WHERE k = 8),
numbered AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c // 256, l[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS fault
  FROM conversations, lookup),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM numbered, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged),
judged AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         i > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE illegal) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
grow(q, c, e, t) AS (
  SELECT * FROM (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 0, '', []), (2, 0, '', []), (3, 0, '', []))),
inserts(f, q, c, e, t) AS (
  SELECT q, q, 0, '', CAST([] AS VARCHAR[]) FROM grow
  UNION ALL SELECT f, CASE WHEN q = 2 THEN 3 ELSE 2 END, c + 5, e || 'I', list_append(t, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END) FROM inserts WHERE c < 10),
ways(conv_id, i, q, c, e, t) AS (
  SELECT conv_id, 0, 0, 0, '', CAST([] AS VARCHAR[]) FROM counts
  UNION ALL
  SELECT conv_id, i, q, least.c, least.e, least.t FROM (
    SELECT w.conv_id, w.i + 1 AS i,
           CASE op WHEN 'D' THEN n.q WHEN 'K' THEN CASE left(j.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN n.q = 2 THEN 3 ELSE 2 END END AS q,
           min(struct_pack(
             c := w.c + n.c + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END,
             e := w.e || n.e || op,
             t := list_concat(list_concat(w.t, n.t), CASE op WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text]
                                                     ELSE [CASE WHEN n.q = 2 THEN 'assistant:' ELSE 'user:' END || j.text] END))) AS least
    FROM ways w JOIN inserts n ON n.f = w.q JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    JOIN (SELECT unnest(['D', 'K', 'R']) AS op) ON op = 'D' OR (j.fault NOT IN ('blank', 'duplicate') AND (op = 'R'
      OR (left(j.role, 1) = 's' AND n.q = 0) OR (left(j.role, 1) = 'u' AND n.q <> 2) OR (left(j.role, 1) = 'a' AND n.q = 2)))
    GROUP BY 1, 2, 3)),
ends AS (
  SELECT w.conv_id, min(struct_pack(c := w.c + n.c, e := w.e || n.e, t := list_concat(w.t, n.t))) AS least
  FROM ways w JOIN counts k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = k.n JOIN inserts n ON n.f = w.q
  WHERE n.q IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(least.c, 0) AS BIGINT) AS cost, coalesce(least.e, '') AS audit,
       sha256(coalesce(array_to_string(least.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from lucidform.llm import edits, queries, repair

import checker

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """turns: (role, text, must go, truncated) -> (cost, audit, repaired lines), by all edits of least cost."""
    best = {0: (0, "", ())}

    def better(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserted(table):
        for _ in range(4):
            for q, (c, w, t) in list(table.items()):
                for r in "ua":
                    if (q, r) in NEXT:
                        better(table, NEXT[q, r], (c + 5, w + "I", (*t, ROLE[r] + ":")))
        return table

    for role, text, must, cut in turns:
        now = {}
        for q, (c, w, t) in inserted(best).items():
            better(now, q, (c + 2, w + "D", t))
            if must:
                continue
            if (q, role[:1]) in NEXT:
                better(now, NEXT[q, role[:1]], (c + 5 * cut, w + "K", (*t, f"{role}:{text}")))
            for r in "ua":
                if (q, r) in NEXT:
                    better(now, NEXT[q, r], (c + 1 + 5 * cut, w + "R", (*t, f"{ROLE[r]}:{text}")))
        best = now
    ends = [w for q, w in inserted(best).items() if q in (0, 3)]
    return min(ends)


def faults(rows):
    """Rows of one conversation in order -> expected result after the conversation's id."""
    seen, turns, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    marks = [r[0] for r in rows if r[0] is not None]
    gaps = max(marks) - min(marks) + 1 - len(set(marks)) if marks else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(turns)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows, damage=False):
    """rows: (conv_id, turn, role, text)."""
    talks = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        own, n = talks.setdefault(conv, []), 1
        if damage:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            n = {0: 0, 3: 2}.get(k, 1)
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            role = "user" if k == 4 else role
        own += [(turn, role, text)] * n
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: faults(sorted(t, key=order)) for c, t in talks.items()}


def as_dict(df):
    rows = df.collect()
    names = [c.split()[0] for c in repair.RESULT.split(", ")][1:]
    got = {r["conv_id"]: tuple(r[c] for c in names) for r in rows}
    assert len(got) == len(rows)
    return got


def table(spark, rows, parts=3):
    names = "conv_id bigint, turn bigint, role string, text string, times2 int, symbols string, part string"
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], names).repartition(parts)


def talks(seed, n, length):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "Why?", "", " \n", "more. \t", "open end", "é", None] + [f"t{i}{rng.choice('.?!,')}" for i in range(60)]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, length)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "ubuntu"))
            rows.append((c if c else None, rng.choice((t, t, t, t // 2, None)), role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed, most", [(1, 4096), (2, 3), (3, 1)])
def test_equals_a_plain_search(spark, seed, most):
    rows = talks(seed, 60, 14)
    assert as_dict(repair.repaired(table(spark, rows), most_rows=most)) == brute(rows)


def test_one_long_conversation_in_many_chunks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(("user", "assistant", "assistant", "system")), f"{rng.randrange(900)}{rng.choice('.,')}") for t in range(1500)]
    rows += [(1, 40, "user", "again.")] * 30 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "x " * 300_000 + ".")]
    got = as_dict(repair.repaired(table(spark, rows, 8), most_rows=37, most_bytes=1000))
    assert got == brute(rows)
    assert len(got[1][6]) >= 1530 and got[2][6] == "KK"


def test_damage_and_empty_conversations(spark):
    rows = talks(8, 200, 6)
    gone = [c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:20]
    rows += [(c, 0, "user", "Hi.") for c in gone]
    got = as_dict(repair.repaired_after_damage(table(spark, rows)))
    assert got == brute(rows, damage=True)
    assert {got[c] for c in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired_after_damage(table(spark, rows).where("false")).collect() == []


def test_op13_equals_a_plain_search_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op13_conversation_repair"](spark, sf)
    assert as_dict(found) == brute(rows, damage=True)
    assert checker.compare(found, checker.connect(sf), queries.ORACLES["op13_conversation_repair"]) == []


@pytest.mark.parametrize("length", [1, 2, 3])
def test_blocks_equal_single_turns(length):
    rng = np.random.default_rng(length)
    symbols = rng.integers(0, edits.SYMBOLS, 500).astype(np.uint8)
    bounds = np.concatenate([[0], np.sort(rng.integers(0, 500, 40)), [500]])
    cost = edits.matrices(symbols, bounds, length)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for x in range(4):
            now = edits._closed([0 if q == x else edits.NEVER for q in range(4)])
            for s in symbols[a:b][::-1]:
                now = edits.before(int(s), now)
            assert [c if c < 1 << 59 else edits.NEVER for c in cost[k, :, x]] == [c if c < edits.NEVER // 2 else edits.NEVER for c in now]
    assert len(edits.tables().vectors) * edits.SYMBOLS**edits.BLOCK < 1 << 23

"""Cheapest edits of a sequence of turns, by precomputed transitions for whole blocks (Four Russians).

Kept turns must read ``(s?(ua)+)?``: four states (nothing yet, after system, after user, after assistant).  Going from
the last turn to the first, the cost of repairing all that follows is a vector over the states; a turn maps it to the
next vector.  Vectors less their least entry are few, since insertions bound the differences between states, so the
transitions for every vector and every block of ``BLOCK`` symbols fit a table: a block is one lookup.  To read the
edits, blocks are expanded again, from the front, each between the vectors at its two ends; at every turn the least
letter that still leads to the least cost is taken, so of all cheapest edit strings the ASCII-least results.
"""

from __future__ import annotations

from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np

#: A symbol is 0 for a turn that must go, else 1 + 2 * (place of the role's initial in ROLES) + (1 if truncated).
ROLES, SYMBOLS, BLOCK = "sua?", 9, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State after an inserted or re-roled turn, and its role; states in which a conversation may end.
AFTER, ROLE, FINAL = (2, 2, 3, 2), ("user", "user", "assistant", "user"), (0, 3)
#: State after a kept turn, by its role's initial and the state before.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "?": {}}
#: A cost that no sequence has between two states of a block.
NEVER = 1 << 20


def _closed(cost: list[int]) -> list[int]:
    """With insertions before the next turn."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[AFTER[q]]) for q, c in enumerate(cost)]
    return [min(c, NEVER) for c in cost]


def before(symbol: int, cost: list[int]) -> list[int]:
    """Costs by state before a turn, from those after it."""
    out = [DELETE + c for c in cost]
    if symbol:
        role, more = ROLES[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
        for q in range(4):
            out[q] = min(out[q], REROLE + more + cost[AFTER[q]])
            if q in KEPT[role]:
                out[q] = min(out[q], KEEP + more + cost[KEPT[role][q]])
    return _closed(out)


def _less(cost: list[int]) -> tuple[tuple[int, ...], int]:
    low = min(cost)
    return tuple(c - low if c < NEVER // 2 else NEVER for c in cost), low


class Tables(NamedTuple):
    """vectors: all normalised cost vectors.  end, unit: numbers of the vector at a conversation's end, and of those
    that only allow one state.  one, block: (next vector, cost taken out) by vector and symbol, or block of symbols."""

    vectors: np.ndarray
    end: int
    unit: list[int]
    one: tuple[np.ndarray, np.ndarray]
    block: tuple[np.ndarray, np.ndarray]


@cache
def tables(length: int = BLOCK) -> Tables:
    starts = [_closed([0 if q in FINAL else NEVER for q in range(4)])] + [_closed([0 if q == x else NEVER for q in range(4)]) for x in range(4)]
    known: dict[tuple[int, ...], int] = {}
    todo = [_less(s)[0] for s in starts]
    for v in todo:
        known.setdefault(v, len(known))
    rows, at = list(known), 0
    to, cost = [], []
    while at < len(rows):
        steps = [_less(before(s, list(rows[at]))) for s in range(SYMBOLS)]
        for v, _ in steps:
            if v not in known:
                known[v] = len(known)
                rows.append(v)
        to.append([known[v] for v, _ in steps])
        cost.append([low for _, low in steps])
        at += 1
    one = np.array(to), np.array(cost)
    many = np.arange(len(rows))[:, None], np.zeros((len(rows), 1), dtype=np.int64)
    for _ in range(length):  # a symbol more at the front
        wide = [one[k][many[0]] for k in (0, 1)]  # (vector, block, symbol)
        many = tuple((w + (many[1][:, :, None] if k else 0)).transpose(0, 2, 1).reshape(len(rows), -1) for k, w in enumerate(wide))
    return Tables(np.array(rows), known[todo[0]], [known[v] for v in todo[1:]], one, (many[0].astype(np.int32), many[1].astype(np.int32)))


def block_code(symbols: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    code = np.zeros(len(at), dtype=np.int64)
    for j in range(length):
        code = code * SYMBOLS + symbols[at + j]
    return code


def sweep(symbols: np.ndarray, bounds: np.ndarray, start: int, length: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(vector, cost taken out) before each sequence, from vector ``start`` after it; sequences side by side."""
    t = tables(length)
    low, at = bounds[:-1], bounds[1:].copy()
    vector, cost = np.full(len(low), start), np.zeros(len(low), dtype=np.int64)
    for size, (to, more) in ((length, t.block), (1, t.one)):
        lanes = np.flatnonzero(at - low >= size)
        while len(lanes):
            at[lanes] -= size
            code = block_code(symbols, at[lanes], size)
            cost[lanes] += more[vector[lanes], code]
            vector[lanes] = to[vector[lanes], code]
            lanes = lanes[at[lanes] - low[lanes] >= size]
    return vector, cost


def matrices(symbols: np.ndarray, bounds: np.ndarray, length: int = BLOCK) -> np.ndarray:
    """(sequences, 4, 4): least cost between each state before a sequence and each state after it."""
    t = tables(length)
    out = np.empty((len(bounds) - 1, 4, 4), dtype=np.int64)
    for x, unit in enumerate(t.unit):
        vector, cost = sweep(symbols, bounds, unit, length)
        held = t.vectors[vector]
        out[:, :, x] = np.where(held < NEVER // 2, held + cost[:, None], 1 << 60)
    return out


@lru_cache(maxsize=1 << 17)
def expanded(vector: tuple[int, ...], block: bytes, state: int) -> tuple[str, int]:
    """(edits, state after) of a block whose costs after it are ``vector``."""
    costs = [list(vector)]
    for s in reversed(block):
        costs.append(before(s, costs[-1]))
    costs.reverse()
    out = []
    for i, s in enumerate(block):
        now, then = costs[i], costs[i + 1]
        role, more = ("?", 0) if not s else (ROLES[(s - 1) // 2], TRUNCATED * ((s - 1) % 2))
        while True:
            if now[state] == DELETE + then[state]:
                out.append("D")
            elif now[state] == INSERT + now[AFTER[state]]:
                out.append("I")
                state = AFTER[state]
                continue
            elif state in KEPT[role] and now[state] == KEEP + more + then[KEPT[role][state]]:
                out.append("K")
                state = KEPT[role][state]
            else:
                out.append("R")
                state = AFTER[state]
            break
    return "".join(out), state


def trace(symbols: bytes, after: tuple[int, ...], state: int, length: int = BLOCK) -> tuple[str, int]:
    """(edits, state after) of a sequence entered in ``state``, if ``after`` are the costs by state of what follows."""
    t = tables(length)
    ends, vectors = [len(symbols)], [_less(list(after))[0]]
    while ends[-1] >= length:
        lo = ends[-1] - length
        code = 0
        for s in symbols[lo : ends[-1]]:
            code = code * SYMBOLS + s
        known = _number(vectors[-1], length)
        vectors.append(tuple(t.vectors[t.block[0][known, code]].tolist()))
        ends.append(lo)
    if ends[-1]:
        ends.append(0)
    out = []
    for k in range(len(ends) - 1, 0, -1):
        edits, state = expanded(vectors[k - 1], bytes(symbols[ends[k] : ends[k - 1]]), state)
        out.append(edits)
    return "".join(out), state


@cache
def _numbers(length: int) -> dict[tuple[int, ...], int]:
    return {tuple(v): k for k, v in enumerate(tables(length).vectors.tolist())}


def _number(vector: tuple[int, ...], length: int) -> int:
    return _numbers(length)[vector]


def last_edits(state: int) -> str:
    """Insertions that close a conversation."""
    out = ""
    while state not in FINAL:
        out, state = out + "I", AFTER[state]
    return out

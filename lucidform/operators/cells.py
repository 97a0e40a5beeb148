"""Tree ensembles over binned rows.

Trees of a fitted ensemble see a row's bins only, so rows of the same bins and class are one cell with a count.  A table
of any length has at most as many cells as its features have combinations of bins; trees are grown on the counts: boosted
trees as on the rows, a forest with a Poisson draw for each cell, which is the sum of the draws of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 1 << 20  # combinations of bins that a driver and a task hold
BINS = 32  # the ensembles' own number of bins
SAMPLE = 10_000  # rows that place a feature's bins, as many as the ensembles take themselves
GROUPS = 2  # training groups that are counted in one pass
MERGE = 1 << 20  # keys that wait until equal ones are added up


def split_points(v: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between bins: midpoints of neighbouring values, or of those nearest to equal shares where there are more
    values than bins; a value equal to a cut lies below it."""
    values, counts = np.unique(v, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = len(v) / bins
    target, out, upto = stride, [], np.cumsum(counts)
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def fits(cuts: Sequence[Sequence[np.ndarray]]) -> bool:
    """Whether the combinations of bins are few enough, whatever the rows are."""
    return all(np.prod([len(c) + 1.0 for c in own]) <= MOST_CELLS for own in cuts)


def _count_task(cuts: dict[int, list[np.ndarray]], folds: int):
    """(grp, key, n): rows of a cell, its key with 2 for held-out rows and 1 for positives in the lowest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {g: [] for g in cuts}

        def merged(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        for b in batches:
            if not b.num_rows:
                continue
            d = b.num_columns - 2
            y = b.column(d).to_numpy(zero_copy_only=False).astype(np.int64)
            sets = b.column(d + 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(d)]
            for g, own in cuts.items():
                cell = np.zeros(b.num_rows, dtype=np.int64)
                for v, c in zip(cols, own):
                    cell = cell * (len(c) + 1) + np.searchsorted(c, v)
                held[g].append(np.unique(cell * 4 + (sets[:, g // folds] == g) * 2 + y, return_counts=True))
                if sum(len(k) for k, _ in held[g][1:]) > MERGE:
                    held[g] = [merged(held[g])]
        for g, parts in held.items():
            if parts:
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), g, dtype=np.int32)), pa.array(keys), pa.array(n)], names=["grp", "key", "n"])

    return run


class Cells:
    """Bins and counts of the cells of one training group: ``train`` and ``test`` have (negatives, positives)."""

    def __init__(self, key: np.ndarray, n: np.ndarray, cuts: Sequence[np.ndarray]):
        cell, at = np.unique(key // 4, return_inverse=True)
        counts = np.zeros((len(cell), 4))
        counts[at, key % 4] = n
        self.train, self.test, self.sizes = counts[:, :2], counts[:, 2:], [len(c) + 1 for c in cuts]
        self.bins = np.stack([i.astype(np.int32) for i in np.unravel_index(cell, self.sizes)], axis=1)

    def f1(self, hit: np.ndarray) -> float:
        """F1 on the held-out rows where cells are predicted to be positive."""
        tp, n, p = self.test[hit, 1].sum(), self.test[hit].sum(), self.test[:, 1].sum()
        return float(2.0 * tp / (n + p)) if tp else 0.0


def counted(rows: DataFrame, cuts: dict[int, list[np.ndarray]], folds: int) -> dict[int, Cells]:
    """Cells of some training groups from one scan of (features.., label, folds); at most MOST_CELLS each."""
    got = rows.mapInArrow(_count_task(cuts, folds), "grp int, key long, n long").groupBy("grp", "key").agg(F.sum("n").alias("n")).toArrow()
    grp, key, n = (got.column(i).to_numpy() for i in range(3))
    return {g: Cells(key[grp == g], n[grp == g], own) for g, own in cuts.items()}


def _split(hist: np.ndarray, impurity, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best gain of each node with its feature and bin.  ``hist`` has (node, feature, bin, statistic), rows first."""
    left = np.cumsum(hist, axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    with np.errstate(all="ignore"):
        gain = impurity(whole) - (left[..., 0] * impurity(left) + right[..., 0] * impurity(right)) / whole[..., 0]
    gain = np.where((left[..., 0] > 0) & (right[..., 0] > 1e-9) & allowed[:, :, None], gain, -np.inf)[:, :, :-1]
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), best], best // gain.shape[2], best % gain.shape[2]


def _gini(s: np.ndarray) -> np.ndarray:
    share = s[..., 1] / s[..., 0]
    return 2.0 * share * (1.0 - share)


def _variance(s: np.ndarray) -> np.ndarray:
    return (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0]


def grow(bins: np.ndarray, sizes: Sequence[int], stats: np.ndarray, depth: int, impurity, some: int | None = None, rng=None, prune: bool = False) -> np.ndarray:
    """Value of every cell in one tree grown on the cells' statistics (rows, sum, ..): the mean of its leaf.

    ``some`` features are drawn for each node; with ``prune`` two leaves of one class become one.
    """
    d, width = len(sizes), max(2, max(sizes))
    node, open_ = np.zeros(len(bins), dtype=np.int64), np.array([0])  # nodes are numbered as in a heap
    total = {0: stats.sum(axis=0)}
    kids: set[int] = set()
    for _ in range(depth):
        place = np.full(int(open_.max()) + 1, -1)
        place[open_] = np.arange(len(open_))
        mine = np.flatnonzero((node <= open_.max()) & (place[np.minimum(node, open_.max())] >= 0))
        at = place[node[mine]]
        hist = np.zeros((len(open_), d, width, stats.shape[1]))
        for f in range(d):
            slot = at * width + bins[mine, f]
            for k in range(stats.shape[1]):
                hist[:, f, :, k] = np.bincount(slot, stats[mine, k], len(open_) * width).reshape(-1, width)
        allowed = np.ones((len(open_), d), dtype=bool)
        if some is not None and some < d:
            allowed = rng.random((len(open_), d)).argsort(axis=1) < some
        gain, feature, cut = _split(hist, impurity, allowed)
        goes = gain > 0
        left = np.cumsum(hist, axis=2)[np.arange(len(open_)), feature, cut]
        for i in np.flatnonzero(goes):
            p = int(open_[i])
            kids.add(p)
            total[2 * p + 1], total[2 * p + 2] = left[i], total[p] - left[i]
        moved = goes[at]
        at, mine = at[moved], mine[moved]
        node[mine] = 2 * node[mine] + 1 + (bins[mine, feature[at]] > cut[at])
        open_ = np.sort(np.concatenate([2 * open_[goes] + 1, 2 * open_[goes] + 2]))
        if not len(open_):
            break
    value = {p: s[1] / s[0] if s[0] > 0 else 0.0 for p, s in total.items()}
    if prune:
        leaf = {p: p not in kids for p in total}
        for p in sorted(kids, reverse=True):
            a, b = 2 * p + 1, 2 * p + 2
            if leaf[a] and leaf[b] and (value[a] > 0.5) == (value[b] > 0.5):
                leaf[p], value[a], value[b] = True, value[p], value[p]
        for p in sorted(p for p in kids if leaf[p]):  # from the top, so that all below a joined node have its value
            value[2 * p + 1] = value[2 * p + 2] = value[p]
    of = np.zeros(max(total) + 1)
    of[list(value)] = list(value.values())
    return of[node]


def boosted(cells: Cells, rounds: int, depth: int, rate: float = 0.1) -> np.ndarray:
    """Which cells gradient boosting of the logistic loss predicts to be positive."""
    sign, score = np.array([-1.0, 1.0]), np.zeros(len(cells.train))
    for m in range(rounds):
        with np.errstate(over="ignore"):
            r = sign + np.zeros_like(cells.train) if m == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * score[:, None]))
        stats = np.stack([cells.train.sum(1), (cells.train * r).sum(1), (cells.train * r * r).sum(1)], axis=1)
        score += (1.0 if m == 0 else rate) * grow(cells.bins, cells.sizes, stats, depth, _variance)
    return score > 0


def votes(cells: Cells, trees: Sequence[int], depth: int, some: int, seed: int) -> np.ndarray:
    """Sum of the shares of positives that some trees of a forest give to the cells; ``some`` features are drawn for a node."""
    out = np.zeros(len(cells.train))
    for t in trees:
        rng = np.random.default_rng([seed, t])
        drawn = rng.poisson(cells.train).astype(float)
        stats = np.stack([drawn.sum(1), drawn[:, 1]], axis=1)
        out += grow(cells.bins, cells.sizes, stats, depth, _gini, some, rng, True)
    return out


def ensembles(spark, found: dict[int, Cells], model: str, size: int, depth: int, seed: int = 42, tasks: int = 8) -> dict[int, float]:
    """By training group: F1 on its held-out rows of a forest ("RF") or of boosted trees ("GB"), grown in tasks."""
    sent = spark.sparkContext.broadcast(found)
    per = 1 if model == "GB" else tasks
    work = [(g, k) for g in found for k in range(per)]

    def run(at: tuple[int, int]) -> tuple[int, int, bytes]:
        g, k = at
        own = sent.value[g]
        v = boosted(own, size, depth).astype(float) if model == "GB" else votes(own, range(k, size, per), depth, len(own.sizes) if size == 1 else int(np.ceil(np.sqrt(len(own.sizes)))), seed)
        return g, k, v.tobytes()

    total: dict[int, np.ndarray] = {}
    for g, _, v in sorted(spark.sparkContext.parallelize(work, len(work)).map(run).collect(), key=lambda r: r[:2]):  # a number a cell
        total[g] = total.get(g, 0.0) + np.frombuffer(v)
    sent.destroy()
    return {g: own.f1(total[g] > (0.5 if model == "GB" else size / 2.0)) for g, own in found.items()}

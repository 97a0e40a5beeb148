"""Scoring thousands of formulas per pass, still exactly.

A pass evaluates every candidate on Arrow batches inside the tasks and counts
(positives, rows) per value bin; Spark adds the counts up.  The counts give, per
candidate, the best F1 at a bin edge (reachable, a lower bound) and the best any
threshold inside a bin could reach (an upper bound).  Candidates whose upper
bound is below the B-th lower bound cannot be among the best B.  What is left
gets finer bins where it is still open, and when few rows are open those rows
alone are counted per distinct value.  The winners and their scores are those
of the exact method; bins only decide how much work that takes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lucidform.functions.formulas import OpSet, sanitize_array
from lucidform.functions.traces import Trace, apply_step, evaluate, feats, leaf, project_formulas
from lucidform.operators.ranking import hash_order, tie_prefix
from lucidform.operators.scoring import CHUNK, SWEEP, VAR_FLOOR, best_cut, covers_percentile, cut_table
from lucidform.session import written
from lucidform.sources.labelled import Labelled, spread, working_copy

BINS = 96
SAMPLE_ROWS = 4096  # rows used only to place bin edges
CELL_BUDGET = 4_000_000  # counters one task holds at a time
OPEN_ROW_FACTOR = 0.006  # finish exactly once open (row, candidate) pairs drop below this share of those that another scan would read
OPEN_ROWS_SMALL = 4_000_000
TASK_ROWS = 500_000  # distinct values that one ordered window of the last step may hold
BLOCK = 32_000  # rows that a task handles at a time
PACK_BLOCK = 256_000  # the same where values move packed: a row that moves holds a block's values of a bin
FEW_SPANS = 4  # so many value ranges are cut out by comparison, for more the block is sorted
FINE_BINS = 512  # bins that divide the open ones of a formula in the passes after the first, so that one such pass is enough as a rule
CUT_BINS = 1024  # the same for a percentile sweep, which leaves one or two open for every percentile
EMIT_ROWS = 200_000  # rows per emitted Arrow batch
MAX_REFINE = 10
MOST_BINS = 2048
PASS_TABLES = 6  # table-sized formulas whose values one pass of exact_scores moves
PASS_ROWS = 8_000_000

_HIST = "cand int, grp int, bin int, n long, p long, s1 double, s2 double, lo double, hi double, a double, m int"
_PACKED = "cand int, bin int, positive boolean, v binary, c binary"
_OPEN = "cand int, grp int, bin int, v double, n long, p long"


@dataclass
class Score:
    """Exact result for one candidate (and one training group, when folds are used)."""

    trace: Trace
    group: int
    f1: float
    direction: int
    threshold: float
    auroc_low: float
    auroc_high: float


def sample_columns(lab: Labelled, seed: int = 0, rows: int = SAMPLE_ROWS) -> list[np.ndarray]:
    """A bounded, reproducible row sample; it places bin edges and nothing else."""
    got = (
        lab.df.select(*[F.col(f).cast("double").alias(f) for f in lab.features], hash_order(seed, lab.rid).alias("_h"))
        .orderBy("_h", *lab.features)
        .limit(rows)
        .drop("_h")
        .toArrow()
    )
    return [np.nan_to_num(got.column(i).to_numpy(), nan=0.0) for i in range(len(lab.features))]


def quantile_edges(v: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Edges near the sample quantiles; a frequent value gets a bin of its own."""
    v = np.sort(v)
    if v.size == 0:
        return np.zeros(1)
    picks = np.unique(v[np.linspace(0, v.size - 1, bins // 2 + 1).astype(int)])
    edges = np.unique(np.concatenate([picks, np.nextafter(picks, np.inf)]))
    return edges


def _ordered_bits(v: np.ndarray) -> np.ndarray:
    b = np.asarray(v, dtype=np.float64).view(np.int64)
    return np.where(b < 0, np.int64(-(2**63)) - b, b)


def _from_ordered_bits(b: np.ndarray) -> np.ndarray:
    return np.where(b < 0, np.int64(-(2**63)) - b, b).astype(np.int64).view(np.float64)


def split_edges(
    edges: np.ndarray, open_bins: Sequence[int], low: float, high: float, bins: int = BINS
) -> tuple[np.ndarray, np.ndarray]:
    """New edges that keep the borders of open bins and divide their insides,
    and which of the new bins are settled (outside every open bin).

    Half of the inner edges are evenly spaced in value and half in the bit
    pattern of the number, so any bin keeps shrinking whatever its tails are.
    """
    per = max(2, bins // max(1, 2 * len(open_bins)))
    out: list[np.ndarray] = []
    spans = []
    for b in open_bins:
        lo = edges[b - 1] if b > 0 else low
        hi = edges[b] if b < len(edges) else np.nextafter(high, np.inf)
        lo_b, hi_b = (int(x) for x in _ordered_bits(np.array([lo, hi])))
        frac = np.arange(1, per) / per
        bits = np.array([lo_b + int((hi_b - lo_b) * f) for f in frac], dtype=np.int64)
        inner = [_from_ordered_bits(bits)]
        with np.errstate(over="ignore"):
            lin = lo + (hi - lo) * frac
        if np.isfinite(lin).all():
            inner.append(lin)
        inside = np.concatenate(inner)
        out += [np.array([lo, hi]), inside[(inside > lo) & (inside < hi)]]
        spans.append((lo, hi))
    new = np.unique(np.concatenate(out))
    settled = np.ones(len(new) + 1, dtype=bool)
    for lo, hi in spans:
        settled[1:] &= ~((new >= lo) & (new < hi))
    return new, settled


def _tree(traces: Sequence[Trace]) -> dict:
    """Candidates arranged by shared prefix, so a parent is evaluated once per batch."""
    root: dict = {}
    for c, t in enumerate(traces):
        node = root
        for step in t:
            node = node.setdefault(step, {})
        node.setdefault("at", []).append(c)
    return root


def _walk(tree: dict, columns: list[np.ndarray], ops: OpSet):
    """Yield (candidate, value array); holds one value per level of depth."""

    def down(node: dict, v: np.ndarray | None):
        for c in node.get("at", ()):
            yield c, v
        for step, child in node.items():
            if step == "at":
                continue
            nv = columns[step[2]] if v is None else apply_step(v, step, columns, ops)
            yield from down(child, nv)

    yield from down(tree, None)


def _batch_columns(batch: pa.RecordBatch, d: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.float64) for i in range(d)]


def _batch_groups(batch: pa.RecordBatch, d: int, n_sets: int) -> list[np.ndarray]:
    if not n_sets:
        return [np.zeros(batch.num_rows, dtype=np.int64)]
    flat = batch.column(d + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return list(np.ascontiguousarray(flat.reshape(-1, n_sets).T))


@dataclass
class Rotations:
    """Derived columns whose weights differ by training group: ``(x - mean) / scale @ weights`` of the group.

    ``folds`` groups belong to one repeat.  Formulas name the derived columns after the table's own; a row has as many
    values of them as it has training groups, so they are made inside the tasks and never stored.
    """

    names: list[str]
    mean: np.ndarray  # (groups, features)
    scale: np.ndarray
    weights: np.ndarray  # (groups, features, derived columns)
    folds: int

    def columns(self, group: int, columns: Sequence[np.ndarray]) -> list[np.ndarray]:
        x = (np.stack(columns, axis=1) - self.mean[group]) / self.scale[group]
        return [sanitize_array(v) for v in (x @ self.weights[group]).T]


def _passes(batch: pa.RecordBatch, d: int, n_sets: int, own: Rotations | None):
    """(columns, labels, group numbers) to count a batch by: once, or once for each training group with its columns."""
    cols, y = _batch_columns(batch, d), batch.column(d).to_numpy(zero_copy_only=False).astype(np.int64)
    sets = _batch_groups(batch, d, n_sets)
    if own is None:
        yield cols, y, sets
        return
    for g in range(len(own.mean)):
        mine = sets[g // own.folds] != g
        if mine.any():
            part = [c[mine] for c in cols]
            yield part + own.columns(g, part), y[mine], [np.full(int(mine.sum()), g)]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to some ``rows`` rows, so that a formula costs one call for many rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(keys: Sequence[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray | None, list[tuple[int, int, int]]]]]:
    """A row order for the first way of keying the rows, and for each way the order on top of it (none for the first)
    with its runs (key, from, to)."""
    first, out = None, []
    for key in keys:
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
        runs = [(int(sorted_keys[i]), int(i), int(j)) for i, j in zip(at, [*at[1:], len(key)])]
        if first is None:
            first, back = order, np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            out.append((None, runs))
        else:
            out.append((back[order], runs))
    return first, out


def _inside(part: np.ndarray, spans: list[tuple[float, float]]) -> np.ndarray:
    """Values inside ascending ranges [from, to), sorted; a range without end has NaN there."""
    if len(spans) <= FEW_SPANS:
        return np.concatenate([part[:0]] + [np.sort(part[part >= low if np.isnan(high) else (part >= low) & (part < high)]) for low, high in spans])
    part = np.sort(part)
    at = np.searchsorted(part, np.array(spans).ravel()).reshape(-1, 2)  # NaN is searched as the largest value
    return np.concatenate([part[i:j] for i, j in at])


def _counted(part: np.ndarray, edges: np.ndarray, spans: list[tuple[float, float]] | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values, and how many of them are below each edge.

    With ``spans``, whose borders are edges and hold all other edges, only values inside them are sorted and returned;
    those before a span are counted by comparison, with the offset between the two counts in its place.
    """
    if not spans or len(spans) > FEW_SPANS:
        part = np.sort(part)
        return part, np.searchsorted(part, edges)
    inside, below = _inside(part, spans), np.empty(len(edges), dtype=np.int64)
    within = np.searchsorted(inside, edges)
    for low, high in spans:
        mine = (edges >= low) & (True if np.isnan(high) else edges <= high)
        before = 0 if np.isneginf(low) else np.count_nonzero(part < low) - np.searchsorted(inside, low)
        below[mine] = within[mine] + before
    return inside, below


def _histogram_task(traces, edges, shift, ops, d, n_sets, n_groups, own=None, spans=None):
    """Counts by binary search of the edges in sorted values: sorting runs of one group and label costs a fraction of
    searching every value among the edges.  Where ``spans`` name the open ranges of a formula, only values inside are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(traces)
        width = max(len(e) for e in edges) + 1
        cells = np.zeros((len(traces), n_groups, width, 2), dtype=np.int64)
        sums = np.zeros((len(traces), n_groups, 2))
        # least and largest value of a bin
        least, most = np.full((len(traces), width), np.inf), np.full((len(traces), width), -np.inf)
        for cols, y, groups in (p for batch in _blocks(batches, BLOCK) for p in _passes(batch, d, n_sets, own)):
            first, ways = _runs([g * 2 + y for g in groups])
            for c, v in _walk(tree, [col[first] for col in cols], ops):
                for order, runs in ways:
                    w = v if order is None else v[order]
                    for key, i, j in runs:
                        part = w[i:j]
                        held, below = _counted(part, edges[c], spans[c] if spans else None)
                        start, end = np.r_[0, below], np.r_[below, j - i]
                        g, label = divmod(key, 2)
                        cells[c, g, : len(start), label] += end - start
                        if order is None:
                            at = start if len(held) == j - i else np.r_[0, np.searchsorted(held, edges[c])]
                            to = np.r_[at[1:], len(held)]
                            full = np.flatnonzero(to > at)
                            least[c, full] = np.minimum(least[c, full], held[at[full]])
                            most[c, full] = np.maximum(most[c, full], held[to[full] - 1])
                        with np.errstate(over="ignore"):
                            dv = part - shift[c]
                            sums[c, g] += dv.sum(), np.dot(dv, dv)
        low, high = least.min(axis=1), most.max(axis=1)
        neg, pos = cells[..., 0], cells[..., 1]
        c, g, b = np.nonzero(neg + pos)
        first = np.zeros(len(c), dtype=bool)
        if len(c):
            # sums ride on the first bin of each (candidate, group)
            key = c * n_groups + g
            first[np.unique(key, return_index=True)[1]] = True
        s = np.where(first[:, None], sums[c, g], 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(c.astype(np.int32)),
                pa.array(g.astype(np.int32)),
                pa.array(b.astype(np.int32)),
                pa.array((neg + pos)[c, g, b]),
                pa.array(pos[c, g, b]),
                pa.array(s[:, 0]),
                pa.array(s[:, 1]),
                pa.array(low[c]),
                pa.array(high[c]),
                pa.array(least[c, b]),
                pa.array((least[c, b] != most[c, b]).astype(np.int32)),
            ],
            names=["cand", "grp", "bin", "n", "p", "s1", "s2", "lo", "hi", "a", "m"],
        )

    return run


def _open_batch(parts: list[tuple]) -> pa.RecordBatch:
    c, g, b, v, n, p = (np.concatenate(x) for x in zip(*parts))
    kinds = (np.int32, np.int32, np.int32, np.float64, np.int64, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(t)) for x, t in zip((c, g, b, v, n, p), kinds)], names=["cand", "grp", "bin", "v", "n", "p"]
    )


def _spans(edges: np.ndarray, wanted: np.ndarray) -> list[tuple[float, float]]:
    """Value ranges [from, to) of the wanted bins, joined with neighbours and over bins of a single double."""
    borders = np.r_[-np.inf, edges, np.nan]
    at = np.flatnonzero(np.diff(np.r_[0, wanted.astype(int), 0]))
    out: list[tuple[float, float]] = []
    for i, j in at.reshape(-1, 2):
        joined = out and np.nextafter(out[-1][1], np.inf) >= borders[i]
        out[-1 if joined else len(out) :] = [(out[-1][0] if joined else borders[i], borders[j])]
    return out


def _open_rows_task(traces, edges, wanted, ops, d, n_sets, own=None):
    """Rows of open bins, counted per distinct value within a block, group and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(traces)
        spans = [_spans(e, w) for e, w in zip(edges, wanted)]
        for cols, y, groups in (p for batch in _blocks(batches, BLOCK) for p in _passes(batch, d, n_sets, own)):
            out, held = [], 0
            first, ways = _runs([g * 2 + y for g in groups])
            for c, v in _walk(tree, [col[first] for col in cols], ops):
                for order, runs in ways:
                    w = v if order is None else v[order]
                    for key, i, j in runs:
                        vs = _inside(w[i:j], spans[c])
                        if not len(vs):
                            continue
                        start = np.flatnonzero(np.r_[True, vs[1:] != vs[:-1]])
                        n = np.diff(np.r_[start, len(vs)])
                        vs = vs[start]
                        g, label = divmod(key, 2)
                        out.append((np.full(len(n), c), np.full(len(n), g), np.searchsorted(edges[c], vs, side="right"), vs, n, n * label))
                        held += len(n)
                if held > EMIT_ROWS:
                    yield _open_batch(out)
                    out, held = [], 0
            if out:
                yield _open_batch(out)

    return run


def _kernel_input(lab: Labelled, group_cols: Sequence[str]) -> DataFrame:
    """Features, label and one array of group numbers."""
    if len(group_cols) == 1 and isinstance(lab.df.schema[group_cols[0]].dataType, ArrayType):
        groups = [F.col(group_cols[0]).cast("array<int>").alias("_groups")]
    else:
        groups = [F.array(*[F.col(g).cast("int") for g in group_cols]).alias("_groups")] if group_cols else []
    return lab.df.select(*[F.col(f).cast("double").alias(f) for f in lab.features], F.col(lab.label).cast("int").alias("_y"), *groups)


def histograms(
    lab: Labelled,
    traces: Sequence[Trace],
    edges: Sequence[np.ndarray],
    shift: Sequence[float],
    ops: OpSet | None = None,
    group_cols: Sequence[str] = (),
    n_groups: int = 1,
    max_tasks: int | None = None,
    n_sets: int | None = None,
    own: Rotations | None = None,
    settled: Sequence[np.ndarray | None] | None = None,
) -> DataFrame:
    """(cand, grp, bin, n, p, s1, s2) over all rows.

    ``group_cols`` hold group numbers, one column per way of grouping the rows
    (a repeat of a fold split) or one array column with ``n_sets`` numbers; numbers of
    different ways do not overlap.  With ``own`` the formulas use columns of each training
    group, and counts are those of the training parts.  Bins that ``settled`` marks are counted,
    but their values aren't looked at.
    ``max_tasks`` coalesces the input without a shuffle: each task sends at most
    candidates x bins counters, so fewer tasks mean less to add up.
    """
    ops = ops or OpSet()
    src = _kernel_input(lab, group_cols)
    if max_tasks is not None:
        src = src.coalesce(max_tasks)
    width = max(len(e) for e in edges) + 1
    per = max(1, CELL_BUDGET // (width * 2 * n_groups))
    out = None
    spans = [None if done is None else _spans(e, ~done) for e, done in zip(edges, settled or [None] * len(edges))]
    for i in range(0, len(traces), per):
        task = _histogram_task(
            list(traces[i : i + per]), list(edges[i : i + per]), list(shift[i : i + per]), ops, len(lab.features), len(group_cols) if n_sets is None else n_sets, n_groups, own,
            spans[i : i + per],
        )
        part = src.mapInArrow(task, _HIST).withColumn("cand", F.col("cand") + i)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("cand", "grp", "bin").agg(
        F.sum("n").alias("n"),
        F.sum("p").alias("p"),
        F.sum("s1").alias("s1"),
        F.sum("s2").alias("s2"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        # a bin with one distinct value has no threshold inside
        (F.max("m") + F.when(F.min("a") == F.max("a"), 0).otherwise(1)).alias("m"),
        F.min("a").alias("a"),
    )


def train_counts(hist: DataFrame, repeats: int, folds: int) -> DataFrame:
    """Counts of the training part of each fold: the repeat's total minus the fold."""
    h = hist.withColumn("rep", F.floor(F.col("grp") / folds))
    total = h.groupBy("cand", "rep", "bin").agg(
        *[F.sum(c).alias(f"_{c}") for c in ("n", "p", "s1", "s2")], F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
        F.max("m").alias("_m"), F.count_distinct("grp").alias("_g")
    )
    fold = total.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select(
        "cand", (F.col("rep") * folds + F.col("f")).cast("int").alias("grp"), "bin", "_n", "_p", "_s1", "_s2", "_lo", "_hi", "_m", "_g"
    )
    return (
        fold.join(hist, ["cand", "grp", "bin"], "left")
        .select(
            "cand", "grp", "bin", *[(F.col(f"_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("n", "p", "s1", "s2")],
            F.col("_lo").alias("lo"),
            F.col("_hi").alias("hi"),
            # values of different folds were not compared with each other
            F.greatest(F.col("_m"), F.when(F.col("_g") > 1, 1).otherwise(0)).alias("m"),
        )
        .where(F.col("n") > 0)
    )


def bounds(hist: DataFrame, ties: bool = False) -> DataFrame:
    """Per (cand, grp): f1 bounds, the reachable threshold bin, AUROC bounds, open bins.

    With ``ties`` those bins are open as well that may hold the threshold to take among those of equal F1: the largest
    where large values are positive, else the least.
    A window here spans the bins of one candidate, at most a few hundred rows.
    """
    key = ["cand", "grp"]
    whole = Window.partitionBy(*key)
    above = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select(
        *key,
        "bin",
        "n",
        "p",
        F.sum("p").over(above).alias("tp"),
        F.sum("n").over(above).alias("np"),
        F.sum("p").over(whole).alias("pos"),
        F.sum("n").over(whole).alias("tot"),
        F.sum("s1").over(whole).alias("s1"),
        F.sum("s2").over(whole).alias("s2"),
        "lo",
        "hi",
        "m",
    )
    tp, npred, p, n, P, N = (F.col(c) for c in ("tp", "np", "p", "n", "pos", "tot"))
    two = F.lit(2.0)
    down = two * tp / (npred + P)
    up = two * (P - tp + p) / (N - npred + n + P)
    # the best threshold inside a bin would take its positives and none of its negatives
    tp0, np0 = tp - p, npred - n
    ub_down = two * tp / (np0 + p + P)
    ub_up = two * (P - tp0) / (N - npred + p + P)
    mixed = (p > 0) & (n > p) & (F.col("m") > 0)
    neg = n - p
    neg_below = (N - P) - (npred - tp)
    h = h.select(
        *key,
        "bin",
        "n",
        "tp",
        "np",
        "p",
        "pos",
        "tot",
        "lo",
        "hi",
        F.greatest(down, up).alias("edge"),
        F.when(mixed, F.greatest(ub_down, ub_up)).otherwise(F.greatest(down, up)).alias("ub"),
        down.alias("down"),
        up.alias("up"),
        F.when(mixed, ub_down).otherwise(down).alias("ub_down"),
        F.when(mixed, ub_up).otherwise(up).alias("ub_up"),
        (p.cast("double") * neg_below).alias("_lo"),
        (p.cast("double") * (neg_below + neg)).alias("_hi"),
        F.greatest(F.col("s2") / N - (F.col("s1") / N) * (F.col("s1") / N), F.lit(0.0)).alias("var"),
    ).withColumn("best", F.max("edge").over(whole))
    best, is_open = F.col("best"), F.col("ub") > F.col("best")
    if ties:
        h = h.withColumns({"_at_down": F.max(F.when(F.col("down") == best, F.col("bin"))).over(whole), "_at_up": F.min(F.when(F.col("up") == best, F.col("bin"))).over(whole)})
        at_down, at_up = F.col("_at_down"), F.col("_at_up")
        is_open = is_open | (F.col("bin") == at_down) | ((F.col("ub_down") >= best) & (F.col("bin") > F.coalesce(at_down, F.lit(-1))))
        is_open = is_open | (at_down.isNull() & (F.col("ub_up") >= best) & (F.col("bin") <= at_up))
    out = h.groupBy(*key).agg(
        F.max("edge").alias("lb"),
        F.max("ub").alias("ub"),
        F.max(F.struct("down", "bin")).alias("down"),
        F.max(F.struct(F.col("up"), (-F.col("bin")).alias("nbin"))).alias("up"),
        F.max("pos").alias("pos"),
        F.max("tot").alias("tot"),
        F.max("var").alias("var"),
        F.min("lo").alias("bounds_lo"),
        F.max("hi").alias("bounds_hi"),
        F.sum("_lo").alias("_lo"),
        F.sum("_hi").alias("_hi"),
        F.collect_list(
            F.when(
                is_open,
                F.struct(
                    "bin", "ub", (F.col("tp") - F.col("p")).alias("tp0"), (F.col("np") - F.col("n")).alias("np0"), "n"
                ),
            )
        ).alias("open"),
    )
    single = (F.col("pos") == 0) | (F.col("pos") == F.col("tot"))
    dead = single | (F.col("var") < VAR_FLOOR)
    area = F.col("pos").cast("double") * (F.col("tot") - F.col("pos"))
    lo, hi = F.try_divide(F.col("_lo"), area), F.try_divide(F.col("_hi"), area)
    return out.select(
        *key,
        F.when(dead, F.lit(0.0)).otherwise(F.col("lb")).alias("lb"),
        F.when(dead, F.lit(0.0)).otherwise(F.col("ub")).alias("ub"),
        "down",
        "up",
        "pos",
        "tot",
        F.col("bounds_lo").alias("lo"),
        F.col("bounds_hi").alias("hi"),
        dead.alias("dead"),
        # max(a, 1-a) over the interval [lo, hi]
        F.when(single, F.lit(0.5)).when(lo >= 0.5, lo).when(hi <= 0.5, F.lit(1.0) - hi).otherwise(F.lit(0.5)).alias("auroc_low"),
        F.when(single, F.lit(0.5)).otherwise(F.greatest(hi, F.lit(1.0) - lo)).alias("auroc_high"),
        F.when(dead & F.lit(not ties), F.array().cast("array<struct<bin:int,ub:double,tp0:bigint,np0:bigint,n:bigint>>")).otherwise(F.col("open")).alias("open"),
    )


def contenders(b: DataFrame, keep: int | None) -> DataFrame:
    """Candidates that can still be among the best ``keep`` of their group.

    The windows run over candidates (a generated set), not over table rows.
    """
    if keep is None:
        return b.withColumn("_bar", F.lit(0.0))
    by_lb = Window.partitionBy("grp").orderBy(F.desc("lb"), "cand")
    whole = Window.partitionBy("grp")
    return (
        b.withColumn("_r", F.row_number().over(by_lb))
        .withColumn("_bar", F.coalesce(F.max(F.when(F.col("_r") == keep, F.col("lb"))).over(whole), F.lit(0.0)))
        .where(F.col("ub") >= F.col("_bar"))
        .drop("_r")
    )


def batchable(traces: Sequence[Trace], ops: OpSet) -> bool:
    """Whether all operators of the formulas have an array form."""
    used = {(op, 2 if kind.startswith("binary") else 1) for t in traces for kind, op, _ in t if kind != "leaf"}
    return all(ops.op(name, arity).array is not None for name, arity in used)


def _as_leaves(lab: Labelled, traces: Sequence[Trace], ops: OpSet) -> Iterator[tuple[int, Labelled, list[Trace]]]:
    """Formulas whose operators have no array form, as columns of their own: from which position on, the table, its leaves."""
    for i in range(0, len(traces), CHUNK):
        part = traces[i : i + CHUNK]
        wide = project_formulas(lab.df, lab.features, part, keep=[lab.label, lab.rid], ops=ops)
        yield i, Labelled(wide, tuple(f"v{k}" for k in range(len(part))), lab.label, lab.rid), [leaf(k) for k in range(len(part))]


def _scores_by_columns(lab: Labelled, traces: Sequence[Trace], keep: int | None, ops: OpSet) -> list[Score]:
    """The same scores where Spark computes the formulas first."""
    out = []
    with working_copy(lab) as kept:  # of the features; values of formulas are made in every pass
        for i, own, leaves in _as_leaves(kept, traces, ops):
            out += [replace(s, trace=traces[i + s.trace[0][2]]) for s in search_scores(own, leaves, keep)]
    return [s for s in out if s.f1 > 0]


def search_scores(
    lab: Labelled,
    traces: Sequence[Trace],
    keep: int | None = None,
    ops: OpSet | None = None,
    sample: list[np.ndarray] | None = None,
    folds: tuple[Sequence[str], int, int] | None = None,
    eligible: Sequence[Sequence[int]] | None = None,
    max_tasks: int | None = None,
    own: Rotations | None = None,
    at_values: bool = False,
) -> list[Score]:
    """Exact scores of the candidates that can be among the best ``keep``.

    With ``folds = (columns, repeats, k)`` every candidate is scored on the
    training part of each fold; ``eligible`` may limit candidates to some folds.
    ``own`` holds columns that each training part has of its own.
    Thresholds separate rows as the best value does; with ``at_values`` they are that value, equal F1 settled as in
    ``scoring.scores_from_prefix``, for formulas of no or one class too.
    The result covers at least the true best ``keep`` per group, in no order.
    """
    ops = ops or OpSet()
    traces = list(traces)
    if not traces:
        return []
    if not batchable(traces, ops):
        if folds:
            raise ValueError("folds need operators with an array form")
        return _scores_by_columns(lab, traces, keep, ops)
    cols, repeats, k = folds if folds else ((), 1, 1)
    n_groups = repeats * k if folds else 1
    sample = sample if sample is not None else sample_columns(lab)
    d = len(lab.features)
    derived = [max(feats(t)) >= d for t in traces]
    some = range(0, n_groups, max(1, n_groups // 5))
    with np.errstate(all="ignore"):
        wide = {g: [*sample, *own.columns(g, sample)] for g in some} if own else {}
        values = [np.concatenate([evaluate(t, wide[g], ops) for g in some]) if w else evaluate(t, sample, ops) for t, w in zip(traces, derived)]
    edges = [quantile_edges(v) for v in values]
    shift = [float(np.median(v)) if len(v) else 0.0 for v in values]
    # formulas with few distinct values collapse inside a batch, however many rows they cover
    distinct = [len(np.unique(v)) for v in values]
    spread = [u if u < len(v) / 2 else 1 << 62 for u, v in zip(distinct, values)]
    del values

    best: dict[tuple[int, int], Score] = {}
    settled: list[np.ndarray | None] = [None] * len(traces)
    live = sorted(range(len(traces)), key=lambda c: (derived[c], c))
    spark = lab.df.sparkSession

    def counted(which: list[int], rotations: Rotations | None) -> DataFrame:
        hist = histograms(
            lab, [traces[c] for c in which], [edges[c] for c in which], [shift[c] for c in which], ops, cols, n_groups, max_tasks, repeats if folds else 0, rotations,
            [settled[c] for c in which],
        )
        return train_counts(hist, repeats, k) if folds and rotations is None else hist.drop("a")

    for turn in range(MAX_REFINE):
        plain, rotated = [c for c in live if not derived[c]], [c for c in live if derived[c]]
        hist = counted(plain, None) if plain else None
        if rotated:
            more = counted(rotated, own).withColumn("cand", F.col("cand") + len(plain))
            hist = more if hist is None else hist.unionByName(more)
        b = bounds(hist, at_values)
        if eligible is not None:
            pairs = [(i, g) for i, c in enumerate(live) for g in eligible[c]]
            b = b.join(F.broadcast(spark.createDataFrame(pairs, "cand int, grp int")), ["cand", "grp"], "left_semi")
        if turn == 0:
            b = contenders(b, keep)
        rows = b.toArrow().to_pylist()  # at most one row per candidate and group
        for r in rows:
            key = (live[r["cand"]], r["grp"])
            found = _edge_score(traces[key[0]], r, edges[key[0]])
            if key not in best:
                best[key] = found
            elif found.f1 > best[key].f1:
                b0 = best[key]
                b0.f1, b0.direction, b0.threshold = found.f1, found.direction, found.threshold
        bars = _bars(best, keep)
        open_rows, todo, waiting, span = 0, {}, [], {}
        for r in rows:
            c = live[r["cand"]]
            span[c] = (r["lo"], r["hi"])
            lb, bar = best[(c, r["grp"])].f1, bars[r["grp"]]
            still = [
                o
                for o in (r["open"] or [])
                if (at_values or (o["ub"] > lb and not _atom(edges[c], o["bin"])))
                and o["ub"] >= max(bar, lb)
                and (settled[c] is None or not settled[c][o["bin"]])
            ]
            if still:
                waiting.append((c, r, still))
                blocks = 1 + r["tot"] // BLOCK
                open_rows += min(sum(min(o["n"], blocks) if _atom(edges[c], o["bin"]) else o["n"] for o in still), spread[c] * blocks)
                todo.setdefault(c, set()).update(o["bin"] for o in still)
        if not todo:
            break
        table_rows = max(r["tot"] for r in rows)
        if open_rows <= max(OPEN_ROW_FACTOR * table_rows * len(todo), OPEN_ROWS_SMALL) or turn == MAX_REFINE - 1:
            _finish(lab, traces, edges, todo, waiting, best, ops, cols, folds, derived, own, at_values)
            break
        live = sorted(todo, key=lambda c: (derived[c], c))
        for c in live:
            edges[c], settled[c] = split_edges(edges[c], sorted(todo[c]), *span[c], FINE_BINS)
    bars = _bars(best, keep)
    return [s for s in best.values() if s.f1 >= bars[s.group]]


def _bars(best: dict[tuple[int, int], Score], keep: int | None) -> dict[int, float]:
    """Per group: the ``keep``-th best F1 reached so far."""
    per: dict[int, list[float]] = {}
    for (_, g), s in best.items():
        per.setdefault(g, []).append(s.f1)
    return {g: sorted(v, reverse=True)[keep - 1] if keep is not None and len(v) >= keep else 0.0 for g, v in per.items()}


def _atom(edges: np.ndarray, b: int) -> bool:
    """A bin that can hold a single double has no threshold inside."""
    return 0 < b < len(edges) and np.nextafter(edges[b - 1], np.inf) >= edges[b]


def _edge_score(trace: Trace, r: dict, edges: np.ndarray) -> Score:
    if r["dead"]:
        return Score(trace, r["grp"], 0.0, 1, 0.0, r["auroc_low"], r["auroc_high"])
    down, up = r["down"], r["up"]
    if down["down"] >= up["up"]:
        b = down["bin"]
        thr = edges[b - 1] if b > 0 else -np.finfo(np.float64).max
        return Score(trace, r["grp"], down["down"], 1, float(thr), r["auroc_low"], r["auroc_high"])
    b = -up["nbin"]
    thr = np.nextafter(edges[b], -np.inf) if b < len(edges) else np.finfo(np.float64).max
    return Score(trace, r["grp"], up["up"], -1, float(-thr), r["auroc_low"], r["auroc_high"])


def _finish(lab, traces, edges, todo, waiting, best_so_far, ops, cols, folds, derived, own, at_values=False) -> None:
    """Count the rows of open bins per distinct value and take the best threshold."""
    dead = {(c, r["grp"]) for c, r, _ in waiting if r["dead"]}
    cands = sorted(todo, key=lambda c: (derived[c], c))
    pos_of = {c: i for i, c in enumerate(cands)}
    n_sets = folds[1] if folds else 0

    def counted(which: list[int], rotations: Rotations | None) -> DataFrame:
        wanted = []
        for c in which:
            w = np.zeros(len(edges[c]) + 1, dtype=bool)
            w[list(todo[c])] = True
            wanted.append(w)
        task = _open_rows_task([traces[c] for c in which], [edges[c] for c in which], wanted, ops, len(lab.features), n_sets, rotations)
        found = _kernel_input(lab, cols).mapInArrow(task, _OPEN).groupBy("cand", "grp", "bin", "v").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        return _training_values(found, folds[2]) if folds and rotations is None else found

    plain, rotated = [c for c in cands if not derived[c]], [c for c in cands if derived[c]]
    rows = counted(plain, None) if plain else None
    if rotated:
        more = counted(rotated, own).withColumn("cand", F.col("cand") + len(plain))
        rows = more if rows is None else rows.unionByName(more.select(*rows.columns))
    heads = [(pos_of[c], r["grp"], o["bin"], o["n"], o["tp0"], o["np0"], r["pos"], r["tot"]) for c, r, still in waiting for o in still]
    j = _running(rows, heads, lab.df.sparkSession)
    two = F.lit(2.0)
    down = F.struct((two * F.col("tp") / (F.col("np") + F.col("pos"))).alias("f1"), F.lit(1).alias("d"), F.col("v").alias("t"))
    up = F.struct(
        (two * (F.col("pos") - F.col("tp") + F.col("p")) / (F.col("tot") - F.col("np") + F.col("n") + F.col("pos"))).alias("f1"),
        F.lit(-1).alias("d"),
        (-F.col("v")).alias("t"),
    )
    best = j.groupBy("cand", "grp").agg(F.max(F.greatest(down, up)).alias("b")).toArrow().to_pylist()
    for r in best:
        key = (cands[r["cand"]], r["grp"])
        s, b = best_so_far[key], r["b"]
        if b["f1"] > s.f1 or (at_values and b["f1"] == s.f1):
            s.f1, s.direction, s.threshold = 0.0 if key in dead else b["f1"], b["d"], b["t"]


def _training_values(rows: DataFrame, k: int) -> DataFrame:
    """Counts of a fold's training part, per distinct value, from those of the folds."""
    h = rows.withColumn("rep", F.floor(F.col("grp") / k))
    total = h.groupBy("cand", "rep", "bin", "v").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.map_from_entries(F.collect_list(F.struct("grp", "n"))).alias("gn"),
        F.map_from_entries(F.collect_list(F.struct("grp", "p"))).alias("gp"),
    )
    grp = (F.col("rep") * k + F.col("f")).cast("int")
    return total.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "cand", grp.alias("grp"), "bin", "v",
        (F.col("n") - F.coalesce(F.try_element_at("gn", grp), F.lit(0))).alias("n"),
        (F.col("p") - F.coalesce(F.try_element_at("gp", grp), F.lit(0))).alias("p"),
    ).where(F.col("n") > 0)


def percentile_scores(
    lab: Labelled,
    traces: Sequence[Trace],
    percentiles: Sequence[float] = SWEEP,
    ops: OpSet | None = None,
    sample: list[np.ndarray] | None = None,
    max_tasks: int | None = None,
) -> DataFrame:
    """(cand, f1, threshold, direction) of the percentile sweep for many candidates.

    Bins locate the order statistics the percentiles need; only rows of those
    bins are counted per value.  Same numbers as ``scoring.percentile_f1``.
    """
    ops = ops or OpSet()
    traces = list(traces)
    if not batchable(traces, ops):
        return reduce(DataFrame.unionByName, [percentile_scores(own, leaves, percentiles).withColumn("cand", F.col("cand") + i) for i, own, leaves in _as_leaves(lab, traces, ops)])
    sample = sample if sample is not None else sample_columns(lab)
    with np.errstate(all="ignore"):
        values = [evaluate(t, sample, ops) for t in traces]
    edges = [quantile_edges(v) for v in values]
    distinct = [len(np.unique(v)) for v in values]
    spread = [u if u < len(v) / 2 else 1 << 62 for u, v in zip(distinct, values)]
    del values
    spark = lab.df.sparkSession
    settled: list[np.ndarray | None] = [None] * len(traces)
    known: list[tuple] = []
    live = list(range(len(traces)))
    pieces: DataFrame | None = None
    above = Window.partitionBy("cand").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("cand")
    for turn in range(MAX_REFINE):
        h = histograms(lab, [traces[c] for c in live], [edges[c] for c in live], [0.0] * len(live), ops, (), 1, max_tasks, settled=[settled[c] for c in live])
        h = h.select(
            "cand", "bin", "n", "p", "m", "a", "lo", "hi",
            F.sum("p").over(above).alias("tp"),
            F.sum("n").over(above).alias("np"),
            F.sum("p").over(whole).alias("pos"),
            F.sum("n").over(whole).alias("tot"),
        )
        rows = h.where(covers_percentile(percentiles)).toArrow().to_pylist()  # at most two bins per candidate and percentile
        open_bins: dict[int, set[int]] = {}
        heads, span, load = [], {}, 0
        for r in rows:
            c, b = live[r["cand"]], r["bin"]
            if settled[c] is not None and settled[c][b]:
                continue
            if r["m"] == 0:
                known.append((c, r["a"], r["p"], r["n"], r["tp"], r["np"], r["pos"], r["tot"]))
                continue
            span[c] = (r["lo"], r["hi"])
            open_bins.setdefault(c, set()).add(b)
            heads.append((c, b, r["n"], r["tp"] - r["p"], r["np"] - r["n"], r["pos"], r["tot"]))
            load += min(r["n"], spread[c] * (1 + r["tot"] // BLOCK))
        if not open_bins:
            break
        table_rows = max(r["tot"] for r in rows)
        if load <= max(OPEN_ROW_FACTOR * table_rows * len(open_bins), OPEN_ROWS_SMALL) or turn == MAX_REFINE - 1:
            pieces = _open_prefix(lab, traces, edges, open_bins, heads, ops)
            break
        live = sorted(open_bins)
        for c in live:
            edges[c], settled[c] = split_edges(edges[c], sorted(open_bins[c]), *span[c], CUT_BINS)
    prefix = None
    if known:
        prefix = spark.createDataFrame(known, "cand int, v double, p long, n long, tp long, np long, pos long, tot long")
    if pieces is not None:
        prefix = pieces if prefix is None else prefix.unionByName(pieces)
    return best_cut(cut_table(prefix, ["cand"], percentiles), ["cand"])


def _open_prefix(lab, traces, edges, open_bins, heads, ops) -> DataFrame:
    """Running totals for the distinct values of the open bins."""
    spark = lab.df.sparkSession
    cands = sorted(open_bins)
    wanted = []
    for c in cands:
        w = np.zeros(len(edges[c]) + 1, dtype=bool)
        w[list(open_bins[c])] = True
        wanted.append(w)
    task = _open_rows_task([traces[c] for c in cands], [edges[c] for c in cands], wanted, ops, len(lab.features), 0)
    rows = (
        _kernel_input(lab, ()).mapInArrow(task, _OPEN).groupBy("cand", "bin", "v").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    )
    at = {c: i for i, c in enumerate(cands)}
    totals = _running(rows.withColumn("grp", F.lit(0)), [(at[c], 0, *rest) for c, *rest in heads], spark)
    names = spark.createDataFrame(list(enumerate(cands)), "cand int, id int")
    return totals.join(F.broadcast(names), "cand").select(F.col("id").alias("cand"), "v", "p", "n", "tp", "np", "pos", "tot")


def _packed_task(traces, edges, wanted, ops, d):
    """Distinct values of open bins in ascending order with their counts, as one pair of arrays a bin, label and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(traces)
        for cols, y, _ in (p for batch in _blocks(batches, PACK_BLOCK) for p in _passes(batch, d, 0, None)):
            sides = [(label, [c[y == label] for c in cols]) for label in (0, 1)]
            for label, mine in sides:
                if not len(mine[0]):
                    continue
                for c, v in _walk(tree, mine, ops):
                    v = np.sort(v)
                    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                    n = np.diff(np.r_[start, len(v)]).astype(np.int32)
                    v = v[start]
                    size = np.diff(np.r_[0, np.searchsorted(v, edges[c]), len(v)])
                    keep = np.repeat(wanted[c][: len(size)], size)
                    bins = np.flatnonzero(wanted[c][: len(size)] & (size > 0))
                    if not len(bins):
                        continue
                    ends = np.r_[0, np.cumsum(size[bins])].astype(np.int32)
                    pack = lambda x: pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(bins), c, dtype=np.int32)), pa.array(bins.astype(np.int32)), pa.array(np.full(len(bins), bool(label))),
                            pack(np.ascontiguousarray(v[keep])), pack(np.ascontiguousarray(n[keep])),
                        ],
                        names=["cand", "bin", "positive", "v", "c"],
                    )

    return run


def _inside_bin(parts: list[tuple], head: tuple[int, int, int, int]) -> tuple[float, float]:
    """Best F1 at the values of a bin, and what its positives add to the rank sum.

    Between positives a threshold only gains negatives, so that the best lies at a positive or at the bin's borders.
    """
    tp0, np0, P, N = head
    sides = {label: [np.repeat(np.frombuffer(b, dtype=np.float64), np.frombuffer(c, dtype=np.int32)) for positive, b, c in parts if positive == label] for label in (False, True)}
    neg, pos = (np.sort(np.concatenate(sides[label])) if sides[label] else np.zeros(0) for label in (False, True))
    if not len(pos):
        return 0.0, 0.0
    start = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    end = np.r_[start[1:], len(pos)]
    below, upto = np.searchsorted(neg, pos[start]), np.searchsorted(neg, pos[start], side="right")
    neg0, neg_below = np0 - tp0, (N - P) - (np0 - tp0) - len(neg)
    tp = tp0 + len(pos) - start
    down = 2.0 * tp / (tp + neg0 + len(neg) - below + P)
    tp = P - tp0 - len(pos) + end
    up = 2.0 * tp / (tp + neg_below + upto + P)
    return float(max(down.max(), up.max())), float(((end - start) * (neg_below + (below + upto) / 2.0)).sum())


def _inside_task(heads: dict[tuple[int, int], tuple[int, int, int, int]]):
    """Packed values in the order of (cand, bin), one bin at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, parts = [], None, []

        def made() -> pa.RecordBatch:
            c, f, u = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(f, pa.float64()), pa.array(u, pa.float64())], names=["cand", "_f1", "_u"])

        for batch in batches:
            cand, b, positive = (batch.column(i).to_pylist() for i in range(3))
            for k, key in enumerate(zip(cand, b)):
                if key != at:
                    if parts:
                        out.append((at[0], *_inside_bin(parts, heads[at])))
                    at, parts = key, []
                parts.append((positive[k], batch.column(3)[k].as_buffer(), batch.column(4)[k].as_buffer()))
            if len(out) > BLOCK:
                yield made()
                out = []
        if parts:
            out.append((at[0], *_inside_bin(parts, heads[at])))
        if out:
            yield made()

    return run


def _same_values(trace: Trace, ops: OpSet) -> Trace:
    """One trace for formulas that differ only in the order of two leaves under a commutative operator."""
    if len(trace) > 1 and trace[1][0] in ("binary", "binary_r") and ops.op(trace[1][1], 2).commutative:
        a, b = sorted((trace[0][2], trace[1][2]))
        return (("leaf", trace[0][1], a), ("binary", trace[1][1], b), *trace[2:])
    return trace


@contextmanager
def _shuffles_released(spark) -> Iterator[None]:
    """Shuffle files of the jobs inside are removed as soon as each job ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _running(rows: DataFrame, heads: list[tuple], spark) -> DataFrame:
    """(cand, grp, v, n, p, pos, tot, tp, np): running totals over the distinct values of open bins.

    ``heads`` has (cand, grp, bin, rows, tp0, np0, pos, tot) of each bin.
    """
    own = spark.createDataFrame([(*h[:3], *h[4:], h[3] > TASK_ROWS) for h in heads], "cand int, grp int, bin int, tp0 long, np0 long, pos long, tot long, large boolean")
    return _running_from(rows, F.broadcast(own), any(h[3] > TASK_ROWS for h in heads))


def _running_from(rows: DataFrame, own: DataFrame, some_large: bool, small_keys: bool = True) -> DataFrame:
    """The same with the bins' totals as a table, marked where a bin may hold more than TASK_ROWS values: such a bin
    is cut at its quantiles, summed piece by piece, and ordered inside the pieces only."""
    key, more = ["cand", "grp", "bin"], ["tp0", "np0", "pos", "tot"]
    mine = rows.join(own, key)
    w = Window.partitionBy(*key).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = mine.where("NOT large").select(*key, "v", "n", "p", *more, F.sum("p").over(w).alias("_tp"), F.sum("n").over(w).alias("_np"))
    if some_large:
        cut = tie_prefix(mine.where("large").select(*key, "v", "p", "n"), key, small_keys=small_keys).select(*key, "v", "n", "p", F.col("tp").alias("_tp"), F.col("np").alias("_np"))
        done = done.unionByName(cut.join(own.drop("large"), key).select(*done.columns))
    return done.select("cand", "grp", "v", "n", "p", "pos", "tot", (F.col("tp0") + F.col("_tp")).alias("tp"), (F.col("np0") + F.col("_np")).alias("np"))


def exact_scores(
    lab: Labelled,
    traces: Sequence[Trace],
    ops: OpSet | None = None,
    sample: list[np.ndarray] | None = None,
    max_tasks: int | None = None,
) -> DataFrame:
    """(cand, f1, auroc) of every candidate, exact, however many there are.

    One scan counts (positives, rows) per bin.  A bin with one distinct value or one class adds to the rank sum, and to the
    reachable F1, by its counts alone.  Values of the other bins move packed and sorted, a few table sizes at a time, and
    are merged bin by bin; bins shrink as the table grows, and one that is still large is cut at its quantiles.  Formulas
    equal by commutativity are scored once.  Same numbers as ``scoring.score``.
    """
    ops = ops or OpSet()
    traces, spark = list(traces), lab.df.sparkSession
    if not batchable(traces, ops):
        return reduce(DataFrame.unionByName, [exact_scores(own, leaves, max_tasks=max_tasks).withColumn("cand", F.col("cand") + i) for i, own, leaves in _as_leaves(lab, traces, ops)])
    sample = sample if sample is not None else sample_columns(lab)
    lab = lab if lab.df.storageLevel.useMemory else lab.with_df(spread(lab.df.select(lab.label, *lab.features)))
    first: dict[Trace, int] = {}
    every = traces
    alike = [(i, first.setdefault(_same_values(t, ops), len(first))) for i, t in enumerate(every)]
    traces = list(first)
    total = lab.df.count()
    with np.errstate(all="ignore"):
        values = [evaluate(t, sample, ops) for t in traces]
    edges = [quantile_edges(v, min(MOST_BINS, max(BINS, 4 * total // TASK_ROWS))) for v in values]
    shift = [float(np.median(v)) if len(v) else 0.0 for v in values]
    distinct = [len(np.unique(v)) for v in values]
    few = [u if u < len(v) / 2 else 1 << 62 for u, v in zip(distinct, values)]
    del values

    above = Window.partitionBy("cand").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cand")
    p, n, tp0, np0, P, N = (F.col(c) for c in ("p", "n", "tp0", "np0", "pos", "tot"))
    bins = written(
        # windows over the bins of a candidate
        histograms(lab, traces, edges, shift, ops, max_tasks=max_tasks).select(
            "cand", "grp", "bin", "n", "p",
            F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("np0"),
            F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("tot"),
            F.sum("s1").over(whole).alias("s1"), F.sum("s2").over(whole).alias("s2"),
            ((p > 0) & (n > p) & (F.col("m") > 0)).alias("open"),
        ),
        "bins",
    )
    todo = bins.where("open").select("cand", "bin", "n", "tp0", "np0", "pos", "tot").toArrow().to_pylist()  # one row per candidate and bin at most
    two = F.lit(2.0)
    neg_below = (N - P) - (np0 - tp0) - (n - p)
    base = bins.groupBy("cand").agg(
        F.max(F.greatest(two * (tp0 + p) / (np0 + n + P), two * (P - tp0) / (N - np0 + P))).alias("f1"),
        F.sum(F.when(F.col("open"), 0.0).otherwise(p.cast("double") * (neg_below + (n - p) / two))).alias("u"),
        F.max("pos").alias("pos"), F.max("tot").alias("tot"), F.max("s1").alias("s1"), F.max("s2").alias("s2"),
    )
    inside, load = [], {}
    for r in todo:
        if r["n"] <= TASK_ROWS:
            load[r["cand"]] = load.get(r["cand"], 0) + r["n"]
    some: list[int] = []
    held = 0
    for c in sorted(load):
        some.append(c)
        held += min(load[c], few[c] * (1 + total // PACK_BLOCK))
        if held >= max(PASS_TABLES * total, PASS_ROWS) or c == max(load):
            heads = {(some.index(r["cand"]), r["bin"]): (r["tp0"], r["np0"], r["pos"], r["tot"]) for r in todo if r["n"] <= TASK_ROWS and r["cand"] in some}
            wanted = [np.zeros(len(edges[k]) + 1, dtype=bool) for k in some]
            for k, at in heads:
                wanted[k][at] = True
            rows = _kernel_input(lab, ()).mapInArrow(_packed_task([traces[k] for k in some], [edges[k] for k in some], wanted, ops, len(lab.features)), _PACKED)
            merged = rows.repartition("cand", "bin").sortWithinPartitions("cand", "bin").mapInArrow(_inside_task(heads), "cand int, _f1 double, _u double")
            with _shuffles_released(spark):
                inside.append(written(merged.withColumn("cand", F.get(F.array(*[F.lit(k) for k in some]), "cand")), "inside"))
            some, held = [], 0
    if any(r["n"] > TASK_ROWS for r in todo):
        wanted = [np.zeros(len(e) + 1, dtype=bool) for e in edges]
        for r in todo:
            wanted[r["cand"]][r["bin"]] |= r["n"] > TASK_ROWS
        task = _open_rows_task(traces, edges, wanted, ops, len(lab.features), 0)
        rows = _kernel_input(lab, ()).mapInArrow(task, _OPEN).groupBy("cand", "grp", "bin", "v").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        own = bins.where(F.col("open") & (n > TASK_ROWS)).select("cand", "grp", "bin", "tp0", "np0", "pos", "tot", F.lit(True).alias("large"))
        tp, npred = F.col("tp"), F.col("np")
        inside.append(_running_from(rows, own, True, False).select(
            "cand",
            F.greatest(two * tp / (npred + P), two * (P - tp + p) / (N - npred + n + P)).alias("_f1"),
            (p.cast("double") * ((N - P) - (npred - tp) + (n - p) / two)).alias("_u"),
        ))
    if inside:
        added = reduce(DataFrame.unionByName, inside).groupBy("cand").agg(F.max("_f1").alias("_f1"), F.sum("_u").alias("_u"))
        base = base.join(added, "cand", "left").withColumns(
            {"f1": F.greatest("f1", "_f1"), "u": F.col("u") + F.coalesce("_u", F.lit(0.0))}
        )
    which = F.broadcast(spark.createDataFrame(alike, "cand int, same int"))  # generated candidates
    base = base.withColumnRenamed("cand", "same").join(which, "same")
    mean = F.col("s1") / N
    single = (P == 0) | (P == N)
    a = F.try_divide(F.col("u"), P.cast("double") * (N - P))
    return base.select(
        "cand",
        F.when(single | (F.col("s2") / N - mean * mean < VAR_FLOOR), 0.0).otherwise(F.col("f1")).alias("f1"),
        F.when(single, 0.5).otherwise(F.greatest(a, F.lit(1.0) - a)).alias("auroc"),
    )


def auroc_bounds(lab: Labelled, traces: Sequence[Trace], ops: OpSet | None = None, max_tasks: int | None = None) -> list[tuple[float, float]]:
    """Bounds of each candidate's AUROC from one scan over fine bins."""
    ops, traces = ops or OpSet(), list(traces)
    out = [(0.5, 1.0)] * len(traces)
    if not batchable(traces, ops):
        return out
    sample = sample_columns(lab, rows=2 * MOST_BINS * 4)
    with np.errstate(all="ignore"):
        edges = [quantile_edges(evaluate(t, sample, ops), 2 * MOST_BINS) for t in traces]
    above = Window.partitionBy("cand").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cand")
    p, n, P, N = (F.col(c) for c in ("p", "n", "pos", "tot"))
    neg_below = (N - P) - (F.coalesce(F.sum(n - p).over(above), F.lit(0))) - (n - p)
    # windows over the bins of a candidate
    bins = histograms(lab, traces, edges, [0.0] * len(traces), ops, max_tasks=max_tasks).select(
        "cand", "p", "n", "m", F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("tot"), "bin"
    ).withColumn("below", neg_below)
    half = (n - p) / F.lit(2.0)
    settled = F.col("m") == 0
    rows = bins.groupBy("cand").agg(
        F.max("pos").alias("pos"), F.max("tot").alias("tot"),
        F.sum(p.cast("double") * (F.col("below") + F.when(settled, half).otherwise(0.0))).alias("low"),
        F.sum(p.cast("double") * (F.col("below") + F.when(settled, half).otherwise(n - p))).alias("high"),
    ).collect()  # one row per candidate
    for r in rows:
        area = r["pos"] * (r["tot"] - r["pos"])
        low, high = (r["low"] / area, r["high"] / area) if area else (0.5, 0.5)
        out[r["cand"]] = max(low, 1 - high, 0.5), max(high, 1 - low)
    return out


def auroc_at_least(lab: Labelled, traces: Sequence[Trace], tau: float, ops: OpSet | None = None, max_tasks: int | None = None) -> list[bool]:
    """Whether each candidate's exact AUROC reaches ``tau``.

    A scan over fine bins bounds it; only candidates whose bounds enclose ``tau`` have all their values compared.
    """
    ops, traces = ops or OpSet(), list(traces)
    bounds = auroc_bounds(lab, traces, ops, max_tasks)
    out = [least >= tau for least, _ in bounds]
    # sums of doubles may differ in their last digits
    unsure = [c for c, (least, most) in enumerate(bounds) if not batchable(traces, ops) or least - 1e-9 < tau <= most + 1e-9]
    if unsure:
        for r in exact_scores(lab, [traces[c] for c in unsure], ops, max_tasks=max_tasks).collect():  # one row per candidate
            out[unsure[r["cand"]]] = r["auroc"] >= tau
    return out

"""Exact and screened scores against brute force."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from lucidform.functions.formulas import BINARY, UNARY, OpSet
from lucidform.functions.traces import apply_step, binary, evaluate, leaf, text, unary
from lucidform.operators import screening
from lucidform.operators.scoring import percentile_f1, score
from lucidform.operators.screening import exact_scores, percentile_scores, quantile_edges, search_scores, split_edges


def brute_f1(v, y):
    p = y.sum()
    if p in (0, len(y)) or np.var(v) < 1e-20:
        return 0.0
    best = 0.0
    for t in np.unique(v):
        for pred in (v >= t, v <= t):
            tp = (pred & (y == 1)).sum()
            best = max(best, 2.0 * tp / (pred.sum() + p))
    return best


def brute_auroc(v, y):
    pos, neg = v[y == 1], v[y == 0]
    if not len(pos) or not len(neg):
        return 0.5
    a = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    return max(a, 1 - a)


def brute_percentile(v, y, ps):
    best = (0.0, 0.0, ">")
    p = y.sum()
    for t in np.percentile(v, ps):
        for d, pred in ((">", v > t), ("<", v < t)):
            tp = (pred & (y == 1)).sum()
            f1 = 2.0 * tp / (pred.sum() + p) if tp else 0.0
            if f1 > best[0]:
                best = (f1, t, d)
    return best


@pytest.fixture(scope="module")
def tied(make):
    rng = np.random.default_rng(3)
    n = 300
    x = np.column_stack([rng.integers(0, 6, n), np.round(rng.normal(size=n), 1), rng.normal(size=n), np.ones(n)])
    y = (x[:, 0] + x[:, 2] + rng.normal(size=n) > 3).astype(int)
    return x, y, make(x, y)


TRACES = [leaf(0), leaf(1), leaf(2), leaf(3), binary(leaf(0), "*", 1), binary(leaf(1), "/", 0), unary("log", binary(leaf(2), "-", 0)), binary(leaf(2), "-", 2)]


def values(x, t):
    return evaluate(t, list(x.T), OpSet())


def test_exact_scores_match_brute_force(tied):
    x, y, lab = tied
    got = {r["formula"]: r for r in score(lab, TRACES).collect()}
    for t in TRACES:
        v = values(x, t)
        r = got[text(t, lab.features)]
        assert r["f1"] == pytest.approx(brute_f1(v, y), abs=1e-12)
        assert r["auroc"] == pytest.approx(brute_auroc(v, y), abs=1e-12)
        if r["f1"] > 0:
            pred = r["direction"] * v >= r["threshold"] - 1e-12 * abs(r["threshold"])
            assert 2.0 * (pred & (y == 1)).sum() / (pred.sum() + y.sum()) == pytest.approx(r["f1"])


def test_single_class_and_constant(make):
    lab = make(np.arange(10.0)[:, None], np.zeros(10))
    r = score(lab, [leaf(0)]).first()
    assert r["f1"] == 0.0 and r["auroc"] == 0.5
    lab = make(np.ones((10, 1)), np.arange(10) % 2)
    r = score(lab, [leaf(0)]).first()
    assert r["f1"] == 0.0 and r["auroc"] == 0.5


def test_partition_count_does_not_matter(tied, make):
    x, y, _ = tied
    one = sorted(map(tuple, score(make(x, y, parts=1), TRACES).collect()), key=str)
    many = sorted(map(tuple, score(make(x, y, parts=64), TRACES).collect()), key=str)
    for a, b in zip(one, many):
        assert a[:6] == b[:6] and a[-1] == b[-1]


@pytest.mark.parametrize("small", [True, False])
def test_screening_keeps_the_true_best(tied, small, monkeypatch):
    import lucidform.operators.screening as sc

    if not small:  # force refinement passes
        monkeypatch.setattr(sc, "OPEN_ROWS_SMALL", 5)
        monkeypatch.setattr(sc, "OPEN_ROW_FACTOR", 0)
        monkeypatch.setattr(sc, "BINS", 8)
    x, y, lab = tied
    traces = [leaf(i) for i in range(3)] + [binary(leaf(i), o, j) for i in range(3) for j in range(3) for o in ("+", "*", "max")]
    want = {t: brute_f1(values(x, t), y) for t in traces}
    got = {s.trace: s for s in search_scores(lab, traces, keep=5)}
    bar = sorted(want.values(), reverse=True)[4]
    for t, f in want.items():
        if f >= bar:
            assert got[t].f1 == pytest.approx(f, abs=1e-12)
            assert got[t].auroc_low - 1e-9 <= brute_auroc(values(x, t), y) <= got[t].auroc_high + 1e-9


@pytest.mark.parametrize("task_rows", [20, 500_000])
def test_f1_and_auroc_in_two_scans(tied, make, monkeypatch, task_rows):
    """Bins that are cut at quantiles or not, ties, a constant, one class only, an empty table."""
    monkeypatch.setattr(screening, "TASK_ROWS", task_rows)
    x, y, lab = tied
    got = {r["cand"]: r for r in exact_scores(lab, TRACES, sample=[c[:9] for c in x.T]).collect()}
    assert sorted(got) == list(range(len(TRACES)))
    for c, t in enumerate(TRACES):
        assert got[c]["f1"] == pytest.approx(brute_f1(values(x, t), y), abs=1e-12)
        assert got[c]["auroc"] == pytest.approx(brute_auroc(values(x, t), y), abs=1e-12)
    one = exact_scores(make(x, np.zeros(len(y))), TRACES[:2]).collect()
    assert [(r["f1"], r["auroc"]) for r in one] == [(0.0, 0.5)] * 2
    assert exact_scores(lab.with_df(lab.df.where("false")), TRACES[:2]).count() == 0


def test_last_step_cuts_large_bins(make, monkeypatch):
    """Every open bin goes through the piecewise sums, after one pass; also for percentiles."""
    monkeypatch.setattr(screening, "TASK_ROWS", 20)
    monkeypatch.setattr(screening, "MAX_REFINE", 1)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(1500, 3)), 2)
    y = (x[:, 0] + rng.normal(size=1500) > 0.3).astype(int)
    lab = make(x, y)
    traces = [leaf(0), leaf(1), binary(leaf(0), "+", 2), binary(leaf(0), "*", 1)]
    for s in search_scores(lab, traces, keep=4):
        assert s.f1 == pytest.approx(brute_f1(values(x, s.trace), y), abs=1e-12)
    ps = list(screening.SWEEP)
    for r in percentile_scores(lab, traces).collect():
        assert r["f1"] == pytest.approx(brute_percentile(values(x, traces[r["cand"]]), y, ps)[0], abs=1e-12)


def test_one_dominating_open_bin_is_spread(spark, monkeypatch):
    """40,000 distinct values of one open bin: no task of the ordered step gets more than a small share."""
    monkeypatch.setattr(screening, "TASK_ROWS", 5000)
    n = 40_000
    rows = spark.range(n).selectExpr("0 AS cand", "0 AS grp", "3 AS bin", "double(id) * id AS v", "1L AS n", "id % 2 AS p")
    small = spark.range(100).selectExpr("1 AS cand", "0 AS grp", "2 AS bin", "double(id) AS v", "1L AS n", "id % 2 AS p")
    heads = [(0, 0, 3, n, 10, 20, n // 2 + 15, n + 50), (1, 0, 2, 100, 0, 0, 50, 100)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = screening._running(rows.unionByName(small), heads, spark)
        most = got.where("cand = 0").groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]
        assert most <= 5000
        top = got.where("cand = 0").orderBy("v").first()
        assert (top["np"], top["tp"]) == (20 + n, 10 + n // 2) and got.count() == n + 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_screening_by_training_fold(tied):
    from lucidform.operators.folds import with_fold_columns

    x, y, lab = tied
    tagged, cols = with_fold_columns(lab, 3, 2)
    fold = {r["rid"]: (r["fold_0"], r["fold_1"]) for r in tagged.df.select("rid", "fold_0", "fold_1").collect()}
    groups = np.array([fold[str(i)] for i in range(len(y))])
    traces = [leaf(1), leaf(2), binary(leaf(0), "+", 2)]
    for s in search_scores(tagged, traces, ops=OpSet(), folds=(cols, 2, 3)):
        train = groups[:, s.group // 3] != s.group
        assert s.f1 == pytest.approx(brute_f1(values(x, s.trace)[train], y[train]), abs=1e-12)


def test_percentile_sweeps_agree_with_numpy(tied):
    x, y, lab = tied
    traces = TRACES[:6]
    ps = [20, 30, 40, 50, 60, 70, 75, 80, 85, 90, 95]
    a = {r["formula"]: r for r in percentile_f1(lab, traces).collect()}
    b = {r["cand"]: r for r in percentile_scores(lab, traces).collect()}
    for k, t in enumerate(traces):
        f1, thr, d = brute_percentile(values(x, t), y, ps)
        for r in (a[text(t, lab.features)], b[k]):
            assert r["f1"] == pytest.approx(f1, abs=1e-12)
            assert r["direction"] == d and r["threshold"] == pytest.approx(thr)


def test_sweep_fixtures(make):
    up = make(np.array([0, 0, 0, 1, 1, 1.0])[:, None], [0, 0, 0, 1, 1, 1])
    assert score(up, [leaf(0)]).first()["f1"] == 1.0
    down = make(np.array([1, 1, 1, 0, 0, 0.0])[:, None], [0, 0, 0, 1, 1, 1])
    r = score(down, [leaf(0)]).first()
    assert r["f1"] == 1.0 and r["direction"] == -1
    assert percentile_f1(down, [leaf(0)]).first()["direction"] == "<"
    nan = make(np.full((100, 1), np.nan), np.arange(100) % 2)
    assert score(nan, [leaf(0)]).first()["f1"] == 0.0


def test_exact_f1_is_invariant_under_increasing_maps(tied):
    x, y, lab = tied
    a = score(lab, [leaf(2), unary("sigmoid", leaf(2)), unary("tanh", leaf(2))]).collect()
    assert len({round(r["f1"], 12) for r in a}) == 1


def test_array_operators_are_finite_at_the_edges():
    a, b = np.array([1.0, 2.0, 0.0]), np.array([0.0, 0.0, -1e-30])
    for o in BINARY.values():
        out = apply_step(a, ("binary", o.name, 1), [a, b], OpSet())
        assert np.isfinite(out).all()
    for o in UNARY.values():
        assert np.isfinite(apply_step(np.array([0.0, -1.0, 800.0]), ("unary", o.name, -1), [], OpSet())).all()


def test_edges_shrink_and_settle():
    e = quantile_edges(np.linspace(0, 1, 1000))
    new, settled = split_edges(e, [2], 0.0, 1.0)
    inside = [i for i in range(len(settled)) if not settled[i]]
    assert inside and new[inside[0] - 1] == e[1] and len(inside) > 5


def _spied(monkeypatch, name):
    calls, real = [], getattr(screening, name)

    def spy(*args, **kwargs):
        calls.append(args)
        return real(*args, **kwargs)

    monkeypatch.setattr(screening, name, spy)
    return calls


def test_catalog_values_move_packed_and_in_passes(tied, monkeypatch):
    """Equal formulas are counted once, and no pass moves more than the formulas it may."""
    monkeypatch.setattr(screening, "PASS_TABLES", 0)
    monkeypatch.setattr(screening, "PASS_ROWS", 1)
    counted, kept = _spied(monkeypatch, "histograms"), _spied(monkeypatch, "written")
    x, y, lab = tied
    traces = [leaf(0), leaf(1), binary(leaf(0), "+", 1), binary(leaf(1), "+", 0), binary(leaf(1), "-", 0)]
    got = {r["cand"]: r for r in exact_scores(lab, traces, sample=[c[:9] for c in x.T]).collect()}
    for c, t in enumerate(traces):
        assert got[c]["f1"] == pytest.approx(brute_f1(values(x, t), y), abs=1e-12)
        assert got[c]["auroc"] == pytest.approx(brute_auroc(values(x, t), y), abs=1e-12)
    assert len(counted[0][1]) == 4
    assert len([1 for _, name in kept if name == "inside"]) > 1


def test_open_rows_are_narrowed_before_they_move(make, monkeypatch):
    """A few formulas over many rows are refined until a small share of the rows is left."""
    monkeypatch.setattr(screening, "OPEN_ROWS_SMALL", 0)
    scans = _spied(monkeypatch, "histograms")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 1))
    y = (x[:, 0] + rng.normal(size=4000) > 0.5).astype(int)
    got = search_scores(make(x, y), [leaf(0)], sample=[x[:9, 0]])
    assert got[0].f1 == pytest.approx(brute_f1(x[:, 0], y), abs=1e-12)
    assert len(scans) > 1


def test_large_fits_do_not_share_the_cluster():
    from lucidform.plans.evaluation import FITS, fits_at_once

    assert fits_at_once(600_000) == FITS and fits_at_once(36_000_000) == 1 and fits_at_once(0) == FITS


def test_later_passes_count_all_and_sort_open_ranges_only():
    """Counts below each edge are those of a full sort, for a few open ranges and for many."""
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=5000), 2)
    edges = quantile_edges(v)
    for bins in ([1], [3, 4, 9], [1, 2, len(edges) - 2], list(range(0, len(edges), 5))):
        new, settled = split_edges(edges, bins, v.min(), v.max(), 64)
        spans = screening._spans(new, ~settled)
        held, below = screening._counted(v, new, spans)
        assert (below == np.searchsorted(np.sort(v), new)).all()
        inside = np.concatenate([v[(v >= low) & (v < high)] for low, high in spans])
        assert (screening._inside(v, spans) == np.sort(inside)).all()
        assert len(held) == (len(v) if len(spans) > screening.FEW_SPANS else len(inside))


def test_values_of_a_bin_merge_by_label():
    """Ties within and across blocks: F1 and rank sum as counted value by value."""
    rng = np.random.default_rng(12)
    v, y = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300).astype(bool)
    parts = []
    for block in range(3):
        for label in (False, True):
            u, c = np.unique(v[block::3][y[block::3] == label], return_counts=True)
            parts.append((label, u.tobytes(), c.astype(np.int32).tobytes()))
    f1, u = screening._inside_bin(parts, (0, 0, int(y.sum()), 300))
    assert f1 == pytest.approx(brute_f1(v, y.astype(int)), abs=1e-12)
    assert u == sum((v[~y] < a).sum() + (v[~y] == a).sum() / 2 for a in v[y])


def test_auroc_limit_is_decided_by_bounds_or_exactly(tied, monkeypatch):
    """Candidates far from the limit need no values; one at the limit is compared exactly."""
    x, y, lab = tied
    traces = [leaf(0), leaf(1), binary(leaf(0), "+", 1), binary(leaf(1), "-", 0)]
    want = [brute_auroc(values(x, t), y) for t in traces]
    exact = _spied(monkeypatch, "exact_scores")
    for tau in (0.4, 1.01):
        assert screening.auroc_at_least(lab, traces, tau) == [a >= tau for a in want]
    assert not exact
    for tau in want:
        assert screening.auroc_at_least(lab, traces, tau - 1e-10) == [a >= tau - 1e-10 for a in want]


def test_column_operators_are_scored_in_blocks(make, monkeypatch):
    """Operators without an array form are computed by Spark and counted in the same passes as others."""
    from lucidform.functions.traces import binary as two

    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(500, 2)), 1)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=500) > 0.4).astype(int)
    lab, ops = make(x, y), OpSet.of({"mean": lambda a, b: (a + b) / 2.0}, {})
    scans = _spied(monkeypatch, "histograms")
    traces = [leaf(0), two(leaf(0), "mean", 1), two(leaf(1), "mean", 1)]
    want = [x[:, 0], (x[:, 0] + x[:, 1]) / 2, x[:, 1]]
    got = {s.trace: s.f1 for s in search_scores(lab, traces, ops=ops)}
    assert len(scans) == 1
    assert [got[t] for t in traces] == pytest.approx([brute_f1(v, y) for v in want], abs=1e-12)
    auroc = {r["cand"]: r["auroc"] for r in exact_scores(lab, traces, ops).collect()}
    assert [auroc[k] for k in range(3)] == pytest.approx([brute_auroc(v, y) for v in want], abs=1e-12)
    cut = {r["cand"]: r["f1"] for r in percentile_scores(lab, traces, ops=ops).collect()}
    assert [cut[k] for k in range(3)] == pytest.approx([brute_percentile(v, y, list(screening.SWEEP))[0] for v in want], abs=1e-12)

"""Searches on tables with known truth, folds, projections, pruning, graphs, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidform.functions.formulas import BINARY, UNARY, Op, OpSet, python_op
from lucidform.functions.traces import binary, evaluate, leaf, text, unary
from lucidform.operators import candidates, graph, projections, tensors
from lucidform.operators import pruning as pr
from lucidform.operators.folds import stratified_folds, with_fold_array, with_fold_columns
from lucidform.operators.metrics import student_p
from lucidform.operators.projections import PCA, PLS, PROJECTIONS, Chain, LinearModel, augment
from lucidform.operators.ranking import dense_codes, exact_quantiles, row_numbers, hash_order
from lucidform.operators.scoring import score
from lucidform.operators.screening import search_scores
from lucidform.operators.graph import connected_components
from lucidform.operators.tensors import group_gram, group_gram_wide, mode_gram, spectrum
from lucidform.plans import queries_tensors, registry
from lucidform.plans import search as se
from lucidform.sources.labelled import Labelled
from lucidform.plans.evaluation import baselines, complexity_gap, fair_cv, fold_criteria, fold_pls
from test_scoring import brute_f1


def table(make, kind, n=500, seed=1):
    rng = np.random.default_rng(seed)
    half = {"circles": 2, "linear": 5, "product": 3}[kind]
    x = rng.uniform(-half, half, (n, 2))
    y = {"circles": (x**2).sum(1) < 1, "linear": x.sum(1) > 0, "product": x[:, 0] * x[:, 1] > 1}[kind]
    return make(x, y)


@pytest.mark.parametrize("kind,least", [("circles", 0.9), ("linear", 0.95), ("product", 0.8)])
def test_known_rules_are_found(make, kind, least):
    r = se.phased_search(table(make, kind))
    assert r.ceiling > least
    conv = [r.convergence[p] for p in sorted(r.convergence)]
    assert conv == sorted(conv)
    f1s = [x["f1"] for x in r.formulas.collect()]
    assert f1s == sorted(f1s, reverse=True)


def test_beam_finds_the_circle_and_stops_at_target(make):
    lab = table(make, "circles")
    r = se.beam_search(lab, 2, 20, "full")
    assert r.best.f1 == 1.0 and "hypot" in text(r.best.trace, lab.features)
    assert se.search(lab, "strict", target=0.3, depth=3).stopped_at == 1
    exact = se.confirm(lab, r, 3).collect()
    assert exact[0]["f1"] == r.best.f1


def test_ablation_never_raises_the_ceiling(make):
    rows = {r["removed"]: r["ceiling"] for r in se.ablation(table(make, "linear", 300), "minimal", 5).collect()}
    assert len(rows) == 5 and all(v <= rows["(none)"] for v in rows.values())


def test_user_operators(make):
    lab = table(make, "linear", 200)
    ops = OpSet.of({"avg": lambda a, b: (a + b) / 2.0}, {})
    assert score(lab, [binary(leaf(0), "avg", 1)], ops=ops).first()["f1"] == 1.0
    ops = OpSet().extended(python_op("mean2", 2, lambda a, b: (a + b) / 2.0), Op("twice", 1, lambda x: x * 2.0))
    assert score(lab, [binary(leaf(0), "mean2", 1)], ops=ops).first()["f1"] == 1.0


def test_folds_are_balanced(make):
    lab = table(make, "circles", 203)
    n = stratified_folds(lab.df, 5, 2).groupBy("repeat", "y", "fold").count().collect()
    for rep in (0, 1):
        for y in (0, 1):
            c = [r["count"] for r in n if r["repeat"] == rep and r["y"] == y]
            assert len(c) == 5 and max(c) - min(c) <= 1


def exchanges(df, column):
    """Shuffles of the plan whose rows hold the column."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.inputPlan())
            continue
        found += node.nodeName() == "Exchange" and f"{column}#" in node.output().mkString(" ")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_rows_move_once_for_all_repeats(make):
    lab = table(make, "circles", 203)
    tagged, cols = with_fold_columns(lab, 5, 20)
    assert len(cols) == 20 and exchanges(tagged.df, "x1") == 1 and exchanges(stratified_folds(lab.df, 5, 20), "x1") == 1
    long = {(r["repeat"], r["rid"]): r["fold"] for r in stratified_folds(lab.df, 5, 20).collect()}
    for r in tagged.df.collect():
        assert [r[c] for c in cols] == [5 * k + long[k, r["rid"]] for k in range(20)]


def test_folds_of_repeated_and_missing_identities(spark):
    rows = [("a", 1, i) for i in range(7)] + [(None, 1, i) for i in range(6)] + [("a", 0, i) for i in range(9)] + [(str(i), 0, i) for i in range(11)]
    d = spark.createDataFrame(rows, "rid string, y int, x int").repartition(3)
    got = stratified_folds(d, 4, 3).collect()
    assert len(got) == 3 * len(rows)
    for rep in range(3):
        for y in (0, 1):
            c = [sum(r["fold"] == f for r in got if r["repeat"] == rep and r["y"] == y) for f in range(4)]
            assert max(c) - min(c) <= 1 and sum(c) == sum(r[1] == y for r in rows)


def test_fair_cv_on_a_clean_rule(make):
    rows = fair_cv(table(make, "linear", 300), folds=3, depth=2, beam=5, pls=1).collect()
    assert len(rows) == 3 and min(r["test_f1"] for r in rows) > 0.9


registry.load_all()


def test_fold_components_equal_fits_on_training_rows(make):
    """Screened scores of per-fold columns against a plain fit and sweep on each training part."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 5))
    y = (x @ np.array([1.0, -2, 0, 0.5, 0]) + rng.normal(size=240) > 0.5).astype(int)
    lab = with_fold_array(make(x, y), 3, 2)
    own = fold_pls(lab, 3, 2, 2)
    rows = {int(r["rid"]): r["folds"] for r in lab.df.select("rid", "folds").collect()}
    folds = np.array([rows[i] for i in range(len(y))])
    traces = [leaf(0), leaf(5), leaf(6), binary(leaf(5), "+", 6), binary(leaf(5), "*", 1), binary(leaf(2), "+", 6)]
    scores = search_scores(lab, traces, folds=(["folds"], 2, 3), own=own)
    assert {(s.trace, s.group) for s in scores} == {(t, g) for t in traces for g in range(6)}
    for s in scores:
        train = folds[:, s.group // 3] != s.group
        t = nipals(x[train], y[train].astype(float), 2)
        w = np.linalg.lstsq(np.c_[x[train], np.ones(train.sum())], t, rcond=None)[0]  # components as a map of columns
        cols = [*x[train].T, *(np.c_[x[train], np.ones(train.sum())] @ w).T]
        got = own.columns(s.group, list(x[train].T))
        for k in range(2):
            assert abs(np.corrcoef(got[k], cols[5 + k])[0, 1]) > 1 - 1e-9
        wide = [*x[train].T, *got]
        assert s.f1 == pytest.approx(brute_f1(evaluate(s.trace, wide, OpSet()), y[train]), abs=1e-12)


def test_plan_width_does_not_depend_on_folds(make):
    lab = table(make, "circles", 120)
    few, many = with_fold_array(lab, 3, 1), with_fold_array(lab, 5, 40)
    assert len(few.df.columns) == len(many.df.columns)
    assert all(len(r["folds"]) == 40 and all(5 * k <= f < 5 * k + 5 for k, f in enumerate(r["folds"])) for r in many.df.collect())


def test_fair_cv_with_subspaces_and_learned_criteria(make):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 6))
    lab = make(x, (x[:, 1] + x[:, 4] > 0.4).astype(int))
    ops = OpSet({k: BINARY[k] for k in ("+", "*")}, {"sq": UNARY["sq"]})
    rules = fold_criteria(with_fold_array(lab, 3), 3, depth=2, top=3, ops=ops)
    assert set(rules) <= {0, 1, 2} and all(d in (1, -1) for _, d, _ in rules.values())
    rows = fair_cv(lab, folds=3, depth=2, beam=6, ops=ops, subspaces=4, subspace_size=4, prune=True).collect()
    assert len(rows) == 3 and all(r["train_f1"] > 0.6 for r in rows)
    whole = fair_cv(lab, folds=3, depth=2, beam=20, ops=ops).collect()
    assert all(r["test_f1"] > 0.9 for r in whole)


def nipals(x, y, k):
    x, y = (x - x.mean(0)) / x.std(0, ddof=1), y - y.mean()
    x0, ws, ps = x.copy(), [], []
    for _ in range(k):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        p = x.T @ t / (t @ t)
        y = y - t * (y @ t) / (t @ t)
        x = x - np.outer(t, p)
        ws.append(w)
        ps.append(p)
    w, p = np.array(ws).T, np.array(ps).T
    return x0 @ w @ np.linalg.inv(p.T @ w)


def test_pls_and_pca_match_numpy(make):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    y = (x[:, 0] - x[:, 3] > 0).astype(float)
    lab = make(x, y)
    m = PLS(lab.features, 3).fit(lab.df)
    got = np.array([list(r) for r in m.transform(lab.df).orderBy(F.col("rid").cast("int")).select(*m.names).collect()])
    want = nipals(x, y, 3)
    for k in range(3):
        assert np.allclose(got[:, k], want[:, k] * np.sign(got[:, k] @ want[:, k]), atol=1e-8)
    p = PCA(lab.features, 2).fit(lab.df)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(p.weights.T), np.abs(vt[:2]), atol=1e-6)
    again = LinearModel.from_json(p.to_json())
    assert np.allclose(again.weights, p.weights)
    both, models = augment(lab, ["pca", "pls"], 2)
    assert len(both.features) == 9 and len(models) == 2


def test_gap_to_fitted_models_by_phase(make):
    lab = table(make, "linear", 300)
    base = baselines(lab, 2, models=["LR", "RF"], sizes={"RF": 5}).cache()
    rows = {(r["model"], r["phase"]): r for r in complexity_gap({1: 0.5, 2: 0.875}, base).collect()}
    assert set(rows) == {(m, k) for m in ("LR", "RF") for k in (1, 2)}
    for (m, k), r in rows.items():
        mean = np.mean([b["f1"] for b in base.collect() if b["model"] == m])
        assert r["ceiling"] == {1: 0.5, 2: 0.875}[k] and r["ensemble"] == pytest.approx(mean, abs=1e-12)
        assert r["gap"] == pytest.approx(mean - r["ceiling"], abs=1e-12)
    assert rows["LR", 1]["ensemble"] > 0.9


def test_learned_criteria_spare_all_alive_nodes(make):
    lab = table(make, "circles", 200)
    cat = pr.catalog(lab, 2, "minimal")
    nodes = pr.node_features(pr.viability(cat, 0.05), 0.2).cache()
    kids = {r["parent"] for r in nodes.where((F.col("alive") == 1) & F.col("parent").isNotNull()).collect()}
    alive = {r["formula"] for r in nodes.where("alive = 1").collect()}
    assert kids <= alive
    crit = pr.criteria("12")
    found = pr.criterion_search(nodes, crit)
    pr.INLINE = 4  # the batch path gives the same rules
    many = {tuple(r) for r in pr.criterion_search(nodes, crit).select("criterion", "direction", "pruned", "total_dead").collect()}
    pr.INLINE = 64
    assert many == {tuple(r) for r in found.select("criterion", "direction", "pruned", "total_dead").collect()}
    assert pr.cross_check(nodes, found, crit).where("fn > 0").count() == 0
    assert pr.admissible_heuristics(pr.node_features(pr.with_hstar(cat), 0.2), crit).where("violations > 0").count() == 0


def test_ranking_helpers(spark):
    d = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).cast("double").alias("v"))
    got = {r["k"]: r["qs"] for r in exact_quantiles(d, ["k"], "v", [0.1, 0.5]).collect()}
    for k in range(3):
        v = np.array([i * 7 % 101 for i in range(1000) if i % 3 == k], dtype=float)
        assert np.allclose(got[k], np.quantile(v, [0.1, 0.5]))
    n = row_numbers(d, ["k"], hash_order(1, F.col("id").cast("string"))).groupBy("k").agg(F.count_distinct("rn").alias("c"), F.max("rn").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["c"] == r["m"] == r["n"] for r in n)
    codes = dense_codes(d.select(F.col("id").cast("string").alias("s")), "s").orderBy("s").collect()
    assert [r["code"] for r in codes] == list(range(1000))


def test_components_and_gram(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101)]
    e = spark.createDataFrame(path, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in {n for p in path for n in p}], "node long")
    got = {r["node"]: r["component"] for r in connected_components(e, nodes).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 3))
    d = spark.createDataFrame([(str(i % 2), *map(float, r)) for i, r in enumerate(x)], "k string, a double, b double, c double")
    one = {(r["k"], r["i"], r["j"]): r["v"] for r in group_gram(d, ["k"], ["a", "b", "c"]).collect()}
    two = {(r["k"], r["i"], r["j"]): r["v"] for r in group_gram_wide(d, "k", ["a", "b", "c"], flush=1).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    sv = {r["k"]: r["sv"] for r in spectrum(group_gram(d, ["k"], ["a", "b", "c"]), ["k"]).collect()}
    assert np.allclose(sv["0"], np.linalg.svd(x[::2].T @ x[::2], compute_uv=False))


def test_p_values(spark):
    # published critical values of Student's t
    rows = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (2.0484, 28, 0.05), (2.7564, 29, 0.01), (1.9623, 1000, 0.05), (0.0, 5, 1.0)]
    for r in spark.createDataFrame(rows, "t double, n int, p double").withColumn("got", student_p(F.col("t"), F.col("n"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-4)


def test_p_values_of_very_many_pairs(spark):
    """Against the finite series for few pairs, and the normal tail with its first correction for very many."""

    def series(t, n):
        a, even = math.atan(abs(t) / math.sqrt(n)), n % 2 == 0
        term = total = 1.0 if even else math.cos(a)
        for k in range(1, (n - (2 if even else 3)) // 2 + 1):
            term *= ((2 * k - 1) / (2 * k) if even else 2 * k / (2 * k + 1)) * math.cos(a) ** 2
            total += term
        return 1 - math.sin(a) * total if even else 1 - 2 / math.pi * (a + (math.sin(a) * total if n > 1 else 0))

    def tail(t, n):
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(abs(t) / math.sqrt(2)) + 2 * density * (t**3 + t) / (4 * n)

    rows = [(t, n, series(t, n)) for n in (1, 2, 3, 4, 7, 29, 30, 999, 5000) for t in (-0.01, 0.3, 1.0, 1.7, 1.8, 2.5, 4.0)]
    rows += [(t, n, tail(t, n)) for n in (10**7, 10**9) for t in (0.001, 0.5, 1.0, 1.72, 1.74, 2.0, 3.0, 6.0)]
    for r in spark.createDataFrame(rows, "t double, n long, p double").withColumn("got", student_p(F.col("t"), F.col("n"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-9), (r["t"], r["n"])


def test_every_projection_is_saved_and_loaded(make, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    lab = make(x, (x[:, 0] > 0).astype(int))
    whole, models = augment(lab, sorted(PROJECTIONS), 2)
    again = Chain.load(_saved(Chain(models), tmp_path))
    assert again.names == [n for m in models for n in m.names] and [type(m) for m in again.models] == [type(m) for m in models]
    a, b = (np.array([list(r) for r in d.orderBy(F.col("rid").cast("int")).select(*again.names).collect()]) for d in (whole.df, again.transform(lab.df)))
    assert np.array_equal(a, b)


def _saved(model, tmp_path):
    model.save(str(tmp_path / "model"))
    return str(tmp_path / "model")


def test_components_with_one_hub_and_long_paths(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HUB", 50)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1090)] + [(399, 1000), (5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in {i for p in edges for i in p if i is not None} | {9999}], "node long")
    got = {r["node"]: r["component"] for r in connected_components(e, nodes).collect()}
    want = {n: 0 if n < 2000 else 5000 if n < 6000 else n for n in got}
    assert got == want and len(got) == nodes.count()


@pytest.mark.parametrize("block", [1024, 3])
def test_unfolding_in_blocks(spark, block):
    """Gram matrices of unfoldings against numpy, with a combination of the other modes that holds most entries."""
    rng = np.random.default_rng(8)
    rows = [("k", int(i), int(j), str(m), float(v)) for i, j, m, v in zip(rng.integers(0, 9, 300), rng.integers(0, 3, 300), rng.integers(0, 2, 300), rng.normal(size=300))]
    rows += [("k", i % 9, 0, "0", 0.5) for i in range(200)] + [("other", 1, 1, "1", 2.0)]
    coo = spark.createDataFrame(rows, "k string, a int, b int, c string, v double").repartition(4)
    for keep in (["a"], ["a", "c"], ["a", "b", "c"]):
        got = {(r["k"], *(tuple(r[f"{m}_{s}"] for m in keep) for s in "ab")): r["v"] for r in mode_gram(coo, ["a", "b", "c"], keep, ["k"], block=block).collect()}
        sums = {}
        for k, a, b, c, v in rows:
            sums[k, a, b, c] = sums.get((k, a, b, c), 0.0) + v
        want = {}
        for (k, *p), v in sums.items():
            for (l, *q), w in sums.items():
                i, j = ([dict(zip("abc", x))[m] for m in keep] for x in (p, q))
                if k == l and all(x == y for m, x, y in zip("abc", p, q) if m not in keep):
                    want[k, tuple(i), tuple(j)] = want.get((k, tuple(i), tuple(j)), 0.0) + v * w
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_ranks_couplings_and_cores_equal_numpy(spark):
    """m03, m05, m06 and m07 on the events tensor."""
    sf = "/root/testdata/sf0.001"
    t = np.zeros((8, 5, 24))
    for r in queries_tensors._coo(spark, sf).collect():
        t[r["u"], r["t"], r["h"]] += r["v"]
    unfold = lambda *m: np.moveaxis(t, m, range(len(m))).reshape(int(np.prod([t.shape[i] for i in m])), -1)
    sv = lambda *m: np.linalg.svd(unfold(*m), compute_uv=False)
    rank = lambda s: int((s / s[0] > 1e-6).sum())
    run = lambda name: registry.QUERIES[name](spark, sf).collect()
    assert {(r["mode"], r["rank"]) for r in run("m03_multilinear_rank")} == {(m, rank(sv(i))) for i, m in enumerate("uth")}
    for r in run("m05_mode_pair_coupling"):
        s = sv(*("uth".index(m) for m in r["pair"].split("-")))
        assert r["eff_rank"] == rank(s) and r["concentration"] == pytest.approx(s[0] ** 2 / (s**2).sum(), abs=1e-6)
    factors = []
    for i in range(3):
        u, s, _ = np.linalg.svd(unfold(i), full_matrices=False)
        k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.99) + 1)
        factors.append(u[:, :k])
    core = np.einsum("uth,ua,tb,hc->abc", t, *factors)
    m06 = run("m06_hosvd")[0]
    assert [m06[f"rank_{m}"] for m in "uth"] == list(core.shape)
    assert m06["error"] == pytest.approx(math.sqrt(1 - (core**2).sum() / (t**2).sum()), abs=1e-4)
    m07 = run("m07_core_sparsity")[0]
    assert m07["total"] == core.size and m07["small"] == int((abs(core) < 0.01 * abs(core).max()).sum())


def test_large_modes_and_many_products_by_block_iterations(spark, make, monkeypatch):
    """A mode beyond GRAM_SIZE, and products beyond GRAM_PRODUCTS, against numpy."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(700, 5)) * np.array([9, 6, 3, 1, 0.5])
    dense = np.einsum("ir,jr->ij", a, np.linalg.qr(rng.normal(size=(12, 5)))[0]).reshape(700, 4, 3)
    coo = spark.createDataFrame([(int(i), int(j), int(k), float(dense[i, j, k])) for i, j, k in np.ndindex(dense.shape)], "a int, b int, c int, v double")
    factors = tensors.hosvd_factors(coo, ["a", "b", "c"], dense.shape)
    u, s, _ = np.linalg.svd(dense.reshape(700, -1), full_matrices=False)
    rank = int(np.searchsorted(np.cumsum(s**2), 0.99 * (s**2).sum()) + 1)
    got, k = factors["a"]
    assert k == rank and got.shape[1] <= tensors.BLOCK_COLUMNS
    assert np.abs(np.abs((got[:, :k] * u[:, :k]).sum(0)) - 1).max() < 1e-6

    x = rng.normal(size=(300, 6)) * np.array([3, 2, 1, 1, 1, 0.5])
    lab = make(x, (x[:, 0] > 0).astype(int))
    exact = PROJECTIONS["tucker"](lab.features, 2).fit(lab.df)
    monkeypatch.setattr(projections, "GRAM_PRODUCTS", 5)
    block = PROJECTIONS["tucker"](lab.features, 2).fit(lab.df)
    assert np.allclose(exact.inner.mean, block.inner.mean) and np.abs(exact.inner.weights - block.inner.weights).max() < 1e-5


def test_stream_scoring(spark, tmp_path):
    from lucidform.streaming.replay import score_stream

    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "value")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    d.write.parquet(src)
    s = spark.readStream.schema(d.schema).parquet(src)
    t = binary(leaf(0), "*", 0)
    q = score_stream(s, ["value"], t, 1, 100.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    q.awaitTermination(60)
    got = spark.read.parquet(out)
    assert got.count() == d.count()
    assert got.where("predicted = 1").count() == d.where("value * value >= 100").count()


def test_user_operators_are_searched(make):
    """Operators given as Column functions only: the search takes the exact path."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    lab = make(x, (x[:, 0] + x[:, 2]) / 2 > 0.3)
    ops = OpSet.of({"avg": lambda a, b: (a + b) / 2.0}, {"cube": lambda a: a * a * a})
    best = se.beam_search(lab, 2, 5, ops).best
    assert best.f1 == 1.0 and text(best.trace, lab.features) in ("(x0 avg x2)", "(x2 avg x0)")
    more = OpSet.preset("minimal").extended(Op("avg", 2, lambda a, b: (a + b) / 2.0))
    assert se.phased_search(lab, more, 3, 3).ceiling > 0.9


def test_cross_check_without_criteria(make):
    """No criterion was learned: no rows, as in the SQL."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    nodes = pr.node_features(pr.viability(pr.catalog(make(x, x[:, 0] > 0), 1, OpSet.preset("minimal"))), 0.5)
    crit = pr.criteria("6")
    none = pr.criterion_search(nodes, crit, least=2.0)
    got = pr.cross_check(nodes, none, crit)
    assert got.count() == 0
    assert got.columns == ["criterion", "fn", "tn", "fp", "tp", "prune_rate", "admissible"]


def test_few_repeats_place_rows_without_identities(spark):
    """Folds as those of ``stratified_folds``, where rows move once a repeat and no identity is joined back."""
    rows = [(None if i % 50 == 0 else str(i % 170), i % 3 // 2, float(i)) for i in range(500)] + [("none", None, 0.0)]
    lab = Labelled(spark.createDataFrame(rows, "rid string, y int, x double").repartition(3), ("x",))
    got = with_fold_array(lab, 4, 2)
    plan = got.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "Generate" not in plan and "LeftOuter" not in plan
    assert all("rightHint=(strategy=broadcast)" in line for line in plan.splitlines() if "Join " in line)
    mine = sorted((f // 4, r["rid"] or "", r["y"], f % 4) for r in got.df.collect() for f in r["folds"])
    want = stratified_folds(lab.df, 4, 2)
    assert mine == sorted((r["repeat"], r["rid"] or "", r["y"], r["fold"]) for r in want.collect())


@pytest.mark.parametrize("case", ["no positives", "constant", "small bins"])
def test_cuts_at_values_of_training_rows(make, monkeypatch, case):
    """Threshold, direction and F1 of each training part as all its values give them; equal F1: up, then the larger threshold."""
    from lucidform.operators import screening

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    x[:, 2] = rng.integers(0, 4, size=600)
    y = (x[:, 0] + rng.normal(size=600) < -0.3).astype(int)
    if case == "small bins":
        monkeypatch.setattr(screening, "OPEN_ROWS_SMALL", 10)
    if case == "no positives":
        y[:] = 0
    if case == "constant":
        x[:] = 2.5
    lab = with_fold_array(make(x, y), 3, 2)
    lab = lab.with_df(lab.df.persist())
    folds = np.array([f for _, f in sorted((int(r["rid"]), r["folds"]) for r in lab.df.collect())])
    holders = {leaf(0): [0, 1, 4], binary(leaf(0), "*", 1): [0, 2, 5], leaf(2): [1, 3]}
    sample = [c[:64] for c in x.T] if case == "small bins" else None
    found = search_scores(lab, list(holders), sample=sample, folds=(["folds"], 2, 3), eligible=list(holders.values()), at_values=True)
    assert {(s.trace, s.group) for s in found} == {(t, g) for t, groups in holders.items() for g in groups}
    for s in found:
        train = folds[:, s.group // 3] != s.group
        v, yt = evaluate(s.trace, list(x[train].T), OpSet()), y[train]
        best = max((2.0 * yt[d * v >= d * c].sum() / ((d * v >= d * c).sum() + yt.sum()), d, d * c) for d in (1, -1) for c in np.unique(v))
        assert (s.f1, s.direction, s.threshold) == ((0.0 if case != "small bins" else best[0]), *best[1:])
    lab.df.unpersist()


def test_every_shorter_criterion_is_expanded(spark, monkeypatch):
    """Criteria to depth 3 equal brute force over all of them, in several families."""
    monkeypatch.setattr(pr, "FAMILY", 700)
    rng = np.random.default_rng(8)
    f1, auroc = rng.uniform(0.2, 0.9, 40), rng.uniform(0.5, 0.9, 40)
    rows = [(f"n{i}", 1 + i % 2, 1 + i % 3, float(f1[i]), float(auroc[i]), int(f1[i] + rng.uniform(0, 0.3) > 0.85)) for i in range(40)]
    nodes = pr.node_features(spark.createDataFrame(rows, "formula string, depth int, n_features int, f1 double, auroc double, alive int"), 0.3)
    ops = OpSet({k: OpSet().binary[k] for k in ("+", "*")}, {"sq": OpSet().unary["sq"]})
    got = {r["criterion"]: r for r in pr.deep_criteria(nodes, 3, ops).collect()}
    two = pr.criteria("all", ops)
    every = {*two, *(binary(t, o, j) for t in two for o in ops.binary for j in range(10)), *(unary("sq", t) for t in two)}
    pdf = nodes.toPandas()
    cols, live = [pdf[n].to_numpy(dtype=float) for n in pr.NODE_PROPERTIES], pdf["alive"].to_numpy() == 1
    want = {}
    for t in every:
        v = evaluate(t, cols, ops)
        down, up = int((v[~live] < v[live].min()).sum()), int((v[~live] > v[live].max()).sum())
        if max(down, up) / (~live).sum() > 0.01 and v.min() < v.max():
            want[text(t, pr.NODE_PROPERTIES)] = (">" if down >= up else "<", max(down, up))
    assert len(want) > 1000
    assert {k: (r["direction"], r["pruned"]) for k, r in got.items()} == want
    assert pr.deep_criteria(nodes, 3, ops).count() == len(want)


@pytest.mark.parametrize(
    "criterion,direction,share",
    [
        (leaf(3), ">", 0.5), (leaf(6), "<", 0.5), (binary(leaf(3), "-", 6), ">", 0.4), (binary(leaf(5), "max", 3), "<", 0.7), (binary(leaf(3), "geometric", 5), ">", 0.5), (leaf(5), ">", 2.0),
    ],
)
def test_pruned_beam_keeps_what_satisfies_the_criterion(make, monkeypatch, criterion, direction, share):
    """The same formulas as a filter by the exact AUROC of every formula of a level, whatever bounds decide."""
    monkeypatch.setattr("lucidform.operators.screening.MOST_BINS", 8)
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(400, 3)), 1)
    lab, ops = make(x, x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) > 0.5), OpSet({k: BINARY[k] for k in ("+", "*", "-")}, {"sq": UNARY["sq"]})
    value = lambda d, r, t: evaluate(criterion, [np.array([c]) for c in (d, len({i for _, _, i in t if i >= 0}), 0.3, r["f1"], 1 - r["f1"], r["auroc"], 1 - r["auroc"], r["f1"] * r["auroc"], 0.0, 0.0)], OpSet())[0]
    exact = lambda traces: {t: r for r in score(lab, traces, ops=ops).collect() for t in traces if text(t, lab.features) == r["formula"]}
    one = [leaf(i) for i in range(3)]
    ones = exact(one)
    limit = 9.0 if share > 1 else float(np.quantile([value(1, ones[t], t) for t in one] + [0.6], share, method="nearest"))
    ok = lambda v: v >= limit if direction == ">" else v <= limit
    best = lambda d, sc, ts: sorted((t for t in ts if ok(value(d, sc[t], t))), key=lambda t: (-sc[t]["f1"], text(t, lab.features)))[:6]
    first = best(1, ones, one) or sorted(one, key=lambda t: -ones[t]["f1"])
    want = {text(t, lab.features) for t in first}
    seen = {candidates.canonical_text(t, lab.features) for t in one}
    two = se._level_candidates(lab, first, ops, seen, True, False, None)
    second = best(2, exact(two), two)
    want |= {text(t, lab.features) for t in second} if second else want | {text(t, lab.features) for t in one}
    got = pr.pruned_beam(lab, criterion, direction, limit, 0.3, 2, 6, ops)
    assert {text(s.trace, lab.features) for _, _, s in got.found} == want


def test_the_pruned_search_goes_deeper_than_its_catalog(spark):
    rows = registry.QUERIES["j08_pruned_beam"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 10 and max(r["depth"] for r in rows) == 3


@pytest.mark.parametrize("kind", ["few values", "many values"])
def test_trees_on_counted_bins_equal_trees_on_rows(make, monkeypatch, kind):
    """Boosted trees predict as those of the library, a forest as well; folds are the same."""
    from lucidform.plans import evaluation

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    x = np.round(x, 1 if kind == "few values" else 6)
    x[:, 1] = np.round(x[:, 1])
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=3000) * 0.3) > 0.4
    lab = make(x, y)
    sizes = {"GB": 12, "RF": 30}
    rows = {(r["fold"], r["model"]): r["f1"] for r in baselines(lab, 3, 1, ["GB", "RF", "LR"], sizes=sizes).collect()}
    monkeypatch.setattr(evaluation, "CELL_ROWS", 100)
    monkeypatch.setattr(evaluation.cells, "GROUPS", 2)
    monkeypatch.setattr(evaluation.cells, "MERGE", 50)
    got = {(r["fold"], r["model"]): r["f1"] for r in baselines(lab, 3, 1, ["GB", "RF", "LR"], sizes=sizes).collect()}
    assert got.keys() == rows.keys()
    for key, f1 in rows.items():
        assert got[key] == pytest.approx(f1, abs={"GB": 2e-3, "RF": 0.03, "LR": 1e-9}[key[1]]), (key, got, rows)
    monkeypatch.setattr(evaluation.cells, "MOST_CELLS", 10)
    many = {(r["fold"], r["model"]): r["f1"] for r in baselines(lab, 3, 1, ["GB"], sizes=sizes).collect()}
    assert many == pytest.approx({k: v for k, v in rows.items() if k[1] == "GB"})


def test_many_repeats_of_a_large_source_are_placed_in_turns(spark, make, monkeypatch):
    """The same folds, with no shuffle left in the plan that is returned."""
    from lucidform.operators import folds

    lab = table(make, "circles", 203)
    want = {(r["repeat"], r["rid"]): r["fold"] for r in stratified_folds(lab.df, 5, 10).collect()}
    monkeypatch.setattr(folds, "TURN_BYTES", -1)
    turns = stratified_folds(lab.df, 5, 10)
    assert turns.columns == stratified_folds(lab.df, 5, 8).columns and exchanges(turns, "rid") == 0
    assert {(r["repeat"], r["rid"]): r["fold"] for r in turns.collect()} == want


def test_kept_rows_are_not_kept_or_moved_again(spark, make):
    """Filters and derived columns of kept rows are made in every pass; large files aren't dealt anew."""
    from lucidform.sources.labelled import spread, working_copy

    lab = table(make, "circles", 200)
    with working_copy(lab) as kept:
        part = kept.augmented({"twice": F.col("x0") * 2}).with_df(kept.augmented({"twice": F.col("x0") * 2}).df.where("x0 > 0"))
        with working_copy(part) as again:
            assert again.df is part.df and not part.df.storageLevel.useMemory
        assert exchanges(spread(part.df), "x0") == 0
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert exchanges(spread(items), "l_tax") == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        assert exchanges(spread(items), "l_tax") == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

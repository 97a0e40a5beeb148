"""Pruning rules learned from a catalog of formulas with lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import Trace, binary, leaf, project_formulas, text, unary
from lucidform.operators import candidates as cd
from lucidform.operators.screening import _batch_columns, _tree, _walk, auroc_bounds, exact_scores, sample_columns
from lucidform.session import written
from lucidform.sources.labelled import Labelled, working_copy

INLINE = 64  # larger families of criteria are evaluated on Arrow batches
FAMILY = 8_192  # criteria that one task evaluates, so that its trees and counters stay small
NODE_ROWS = 32_000  # nodes that one task reads at least where there are so many
SLACK = 1e-9  # what bounds of a criterion leave to its exact value
#: Properties of a formula that criteria are made of: where it stands, what it scores, and what it lacks.
NODE_PROPERTIES = ("depth", "inputs", "base_rate", "f1", "f1_missing", "auroc", "auroc_missing", "f1_times_auroc", "auroc_per_feature", "both_missing")


def catalog(lab: Labelled, depth: int = 2, ops: OpSet | str = "minimal", max_tasks: int | None = None) -> DataFrame:
    """(formula, parent, depth, n_features, f1, auroc) of every formula to a depth.

    Parent and child texts carry the lineage; constant formulas are left out, and
    with them what would grow from them.  A level costs two scans, whatever its size.
    """
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    spark = lab.df.sparkSession
    names = lab.features
    parts: list[DataFrame] = []
    level = cd.leaves(spark, names)
    sample = sample_columns(lab)
    with working_copy(lab.with_df(lab.df.select(lab.label, *lab.features))) as kept:
        for d in range(1, depth + 1):
            got = cd.collect_traces(cd.dedup_formula(level))
            traces = [t for t, _ in got]
            nodes = spark.createDataFrame(
                [(k, text(t, names), text(t[:-1], names) if len(t) > 1 else None, d, row["n_features"]) for k, (t, row) in enumerate(got)],
                "cand int, formula string, parent string, depth int, n_features int",
            )
            s = written(exact_scores(kept, traces, ops, sample, max_tasks).where(F.col("f1") > 0), "level")
            if d < depth:
                level = cd.expand(cd.from_traces(spark, [traces[r["cand"]] for r in s.select("cand").orderBy("cand").collect()], names), names, ops)
            parts.append(s.join(F.broadcast(nodes), "cand"))
    return reduce(DataFrame.unionByName, parts).select("formula", "parent", "depth", "n_features", "f1", "auroc")


def viability(cat: DataFrame, eps: float = 0.005, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``alive``: within eps of the best, or with an alive child.

    Deepest level first; each level is one aggregate of its children.
    """
    max_depth = cat.agg(F.max("depth")).first()[0]
    top = cat.groupBy(*by).agg(F.max("f1").alias("_best"))
    c = cat.join(F.broadcast(top), list(by)) if by else cat.crossJoin(F.broadcast(top))
    c = c.withColumn("alive", F.when(F.col("f1") >= F.col("_best") - F.lit(eps) if "eps" not in by else F.col("f1") >= F.col("_best") - F.col("eps"), 1).otherwise(0)).drop("_best")
    done = c.where(F.col("depth") == max_depth)
    out = [done]
    for d in range(max_depth - 1, 0, -1):
        below = done.groupBy(*by, F.col("parent").alias("_f")).agg(F.max("alive").alias("_up"))
        here = c.where(F.col("depth") == d)
        cond = F.col("formula") == F.col("_f")
        if by:
            below = below.select(*[F.col(k).alias(f"_b_{k}") for k in by], "_f", "_up")
            for k in by:
                cond = cond & (F.col(k) == F.col(f"_b_{k}"))
        done = here.join(below, cond, "left").withColumn("alive", F.greatest("alive", F.coalesce("_up", F.lit(0)))).select(*c.columns)
        out.append(done)
    return reduce(DataFrame.unionByName, out)


def node_features(cat: DataFrame, prevalence: float) -> DataFrame:
    f1, a, nf = F.col("f1"), F.col("auroc"), F.col("n_features").cast("double")
    return cat.withColumns(
        {
            "inputs": nf,
            "f1_missing": F.lit(1.0) - f1,
            "auroc_missing": F.lit(1.0) - a,
            "base_rate": F.lit(float(prevalence)),
            "f1_times_auroc": f1 * a,
            "auroc_per_feature": a / F.greatest(nf, F.lit(0.01)),
            "both_missing": (F.lit(1.0) - f1) * (F.lit(1.0) - a),
        }
    )


def criteria(family: str, ops: OpSet | None = None, names: Sequence[str] = NODE_PROPERTIES) -> list[Trace]:
    """Criterion formulas over node features: a few fixed ones, or all to depth 2."""
    at = {n: i for i, n in enumerate(names)}
    small = [leaf(at["f1"]), leaf(at["auroc"])]
    six = [*small, leaf(at["f1_times_auroc"]), leaf(at["auroc_per_feature"]), binary(leaf(at["f1"]), "+", at["auroc"]), binary(leaf(at["f1"]), "/", at["inputs"])]
    if family == "2":
        return small
    if family == "6":
        return six
    if family == "12":
        return six + [
            binary(leaf(at["auroc"]), "-", at["f1_missing"]),
            binary(leaf(at["f1"]), "max", at["auroc"]),
            binary(leaf(at["f1"]), "min", at["auroc"]),
            binary(leaf(at["f1"]), "geometric", at["auroc"]),
            binary(leaf(at["auroc"]), "/", at["depth"]),
            leaf(at["both_missing"]),
        ]
    ops = ops or OpSet.preset("full")
    one = [leaf(i) for i in range(len(names))]
    two = [binary(leaf(i), o, j) for i in range(len(names)) for j in range(len(names)) if i != j for o in ops.binary]
    return one + two + [unary(u, leaf(i)) for i in range(len(names)) for u in ops.unary]


def criterion_search(
    nodes: DataFrame, traces: Sequence[Trace], below_depth: int | None = None, by: Sequence[str] = (), least: float = 0.01, names: Sequence[str] = NODE_PROPERTIES, ops: OpSet | None = None
) -> DataFrame:
    """Per criterion: the cut that spares every alive node and the share of dead
    nodes it removes, in the better direction.

    Two aggregates over (node, criterion) values; no value is collected.
    """
    src = nodes if below_depth is None else nodes.where(F.col("depth") < below_depth)
    if len(traces) > INLINE and not by:
        return _many_criteria(src, list(traces), names, ops or OpSet(), least)
    parts = []
    for i in range(0, len(traces), 64):
        chunk = list(traces[i : i + 64])
        wide = project_formulas(src, names, chunk, keep=[*by, "alive"], ops=ops)
        label = F.array(*[F.lit(text(t, names)) for t in chunk])
        parts.append(
            wide.select(*by, "alive", F.posexplode(F.array(*[F.col(f"v{k}") for k in range(len(chunk))])).alias("c", "v")).select(
                *by, "alive", F.get(label, F.col("c")).alias("criterion"), "v"
            )
        )
    long = reduce(DataFrame.unionByName, parts)
    keys = [*by, "criterion"]
    live = F.col("alive") == 1
    cut = long.groupBy(*keys).agg(
        F.min(F.when(live, F.col("v"))).alias("low"), F.max(F.when(live, F.col("v"))).alias("high"),
        F.sum(F.when(live, 1).otherwise(0)).alias("total_alive"), F.sum(F.when(live, 0).otherwise(1)).alias("total_dead"),
        F.var_pop("v").alias("_var"),
    ).where((F.col("total_alive") > 0) & (F.col("total_dead") > 0) & (F.col("_var") >= 1e-20))
    dead = long.where(~live).join(F.broadcast(cut), keys)
    g = dead.groupBy(*keys).agg(
        F.max("low").alias("low"), F.max("high").alias("high"), F.max("total_alive").alias("total_alive"), F.max("total_dead").alias("total_dead"),
        F.sum(F.when(F.col("v") < F.col("low"), 1).otherwise(0)).alias("_dn"),
        F.sum(F.when(F.col("v") > F.col("high"), 1).otherwise(0)).alias("_up"),
    )
    down = F.col("_dn") >= F.col("_up")
    pruned = F.greatest("_dn", "_up")
    return g.select(
        *keys, F.when(down, ">").otherwise("<").alias("direction"), F.when(down, F.col("low")).otherwise(F.col("high")).alias("threshold"),
        pruned.alias("pruned"), "total_dead", "total_alive", (pruned / F.col("total_dead")).alias("prune_rate"),
    ).where(F.col("prune_rate") > least)


def _extremes_task(traces, ops, d):
    """Per criterion: range over alive nodes, overall range and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(traces)
        low, high = np.full(len(traces), np.inf), np.full(len(traces), -np.inf)
        least, most = low.copy(), high.copy()
        alive = dead = 0
        for b in batches:
            cols = _batch_columns(b, d)
            live = b.column(d).to_numpy(zero_copy_only=False) == 1
            alive, dead = alive + int(live.sum()), dead + int((~live).sum())
            for c, v in _walk(tree, cols, ops):
                if len(v):
                    least[c], most[c] = min(least[c], v.min()), max(most[c], v.max())
                if live.any():
                    low[c], high[c] = min(low[c], v[live].min()), max(high[c], v[live].max())
        n = len(traces)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype=np.int32)), *(pa.array(x) for x in (low, high, least, most)), pa.array(np.full(n, alive)), pa.array(np.full(n, dead))],
            names=["c", "low", "high", "least", "most", "alive", "dead"],
        )

    return run


def _spared_task(traces, ops, d, low, high):
    """Per criterion: dead nodes outside the range of the alive ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(traces)
        dn, up = np.zeros(len(traces), dtype=np.int64), np.zeros(len(traces), dtype=np.int64)
        for b in batches:
            cols = _batch_columns(b, d)
            gone = b.column(d).to_numpy(zero_copy_only=False) != 1
            for c, v in _walk(tree, cols, ops):
                dn[c] += int((v[gone] < low[c]).sum())
                up[c] += int((v[gone] > high[c]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(traces), dtype=np.int32)), pa.array(dn), pa.array(up)], names=["c", "dn", "up"])

    return run


def _many_criteria(src: DataFrame, traces: list[Trace], names: Sequence[str], ops: OpSet, least: float) -> DataFrame:
    """Two passes over the nodes for a large family of criteria: tasks take a block of nodes and FAMILY criteria each and
    send one row per criterion.  The driver holds two cuts a criterion."""
    n = len(traces)
    rows = written(src.select(*[F.col(c).cast("double").alias(c) for c in names], F.col("alive").cast("int")), "nodes")
    rows = rows.coalesce(max(1, rows.count() // NODE_ROWS))

    def by_family(task: Callable, schema: str) -> DataFrame:
        parts = [rows.mapInArrow(task(i, traces[i : i + FAMILY]), schema).withColumn("c", F.col("c") + i) for i in range(0, n, FAMILY)]
        return reduce(DataFrame.unionByName, parts)

    first = by_family(lambda i, some: _extremes_task(some, ops, len(names)), "c int, low double, high double, least double, most double, alive long, dead long")
    cut = written(
        first.groupBy("c").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"),
            F.sum("alive").alias("total_alive"), F.sum("dead").alias("total_dead"),
        ),
        "cuts",
    )
    low, high = np.full(n, -np.inf), np.full(n, np.inf)
    ends = cut.select("c", "low", "high").toArrow()  # one row per criterion
    low[ends["c"].to_numpy()], high[ends["c"].to_numpy()] = ends["low"].to_numpy(), ends["high"].to_numpy()
    hit = by_family(lambda i, some: _spared_task(some, ops, len(names), low[i : i + FAMILY], high[i : i + FAMILY]), "c int, dn long, up long")
    hit = hit.groupBy("c").agg(F.sum("dn").alias("dn"), F.sum("up").alias("up"))
    down, pruned = F.col("dn") >= F.col("up"), F.greatest("dn", "up")
    usable = (F.col("total_alive") > 0) & (F.col("total_dead") > 0) & (F.col("least") != F.col("most"))
    texts = src.sparkSession.createDataFrame(pa.table({"c": pa.array(range(n), pa.int32()), "criterion": [text(t, names) for t in traces]}))
    return cut.where(usable).join(hit, "c").join(texts, "c").select(
        "criterion", F.when(down, ">").otherwise("<").alias("direction"), F.when(down, F.col("low")).otherwise(F.col("high")).alias("threshold"),
        pruned.alias("pruned"), "total_dead", "total_alive", (pruned / F.col("total_dead")).alias("prune_rate"),
    ).where(F.col("prune_rate") > least)


def deep_criteria(nodes: DataFrame, below_depth: int | None = None, ops: OpSet | str = "full") -> DataFrame:
    """Criteria to depth 3: every shorter one, expanded once more; each formula once."""
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    first = criteria("all", ops)
    longer = [binary(t, o, j) for t in first for o in ops.binary for j in range(len(NODE_PROPERTIES))] + [unary(u, t) for t in first for u in ops.unary]
    return criterion_search(nodes, list(dict.fromkeys([*first, *longer])), below_depth, ops=ops)


def pareto(cat: DataFrame, prevalence: float, eps: Sequence[float], traces: Sequence[Trace], below_depth: int) -> DataFrame:
    """(eps, best criterion, prune_rate, total_alive): all tolerances in one plan."""
    e = cat.sparkSession.createDataFrame([(float(x),) for x in eps], "eps double")
    alive = viability(cat.crossJoin(F.broadcast(e)), by=["eps"])
    c = criterion_search(node_features(alive, prevalence), traces, below_depth, by=["eps"], least=-1.0)
    pick = F.struct(F.col("prune_rate"), F.col("criterion"))
    return c.groupBy("eps").agg(
        F.max_by(F.struct("criterion", "prune_rate", "total_alive"), pick).alias("b")
    ).select("eps", "b.*")


def cross_check(nodes: DataFrame, found: DataFrame, traces: Sequence[Trace], names: Sequence[str] = NODE_PROPERTIES) -> DataFrame:
    """(criterion, fn, tn, fp, tp, prune_rate, admissible): criteria applied to another catalog; no rows without criteria."""
    by_text = {text(t, names): t for t in traces}
    chosen = [by_text[r["criterion"]] for r in found.select("criterion").distinct().orderBy("criterion").collect()]
    if not chosen:
        return nodes.sparkSession.createDataFrame([], "criterion string, fn long, tn long, fp long, tp long, prune_rate double, admissible boolean")
    wide = project_formulas(nodes, names, chosen, keep=["alive"])
    label = F.array(*[F.lit(text(t, names)) for t in chosen])
    long = wide.select("alive", F.posexplode(F.array(*[F.col(f"v{k}") for k in range(len(chosen))])).alias("c", "v")).select(
        "alive", F.get(label, F.col("c")).alias("criterion"), "v"
    )
    j = long.join(F.broadcast(found.select("criterion", "direction", "threshold")), "criterion")
    keep = F.when(F.col("direction") == ">", F.col("v") >= F.col("threshold")).otherwise(F.col("v") <= F.col("threshold"))
    live = F.col("alive") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = j.groupBy("criterion").agg(n(live & ~keep).alias("fn"), n(~live & ~keep).alias("tn"), n(~live & keep).alias("fp"), n(live & keep).alias("tp"))
    return g.withColumn("prune_rate", F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))).otherwise(F.lit(0.0))).withColumn(
        "admissible", F.col("fn") == 0
    )


def feature_ranges(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, alive/dead ranges, overlap, prune_rate) per single node feature."""
    long = nodes.select("alive", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])).alias("s")).select("alive", "s.*")
    live = F.col("alive") == 1
    r = long.groupBy("feature").agg(
        F.min(F.when(live, F.col("v"))).alias("alive_low"), F.max(F.when(live, F.col("v"))).alias("alive_high"),
        F.min(F.when(~live, F.col("v"))).alias("dead_low"), F.max(F.when(~live, F.col("v"))).alias("dead_high"),
    )
    d = long.where(~live).join(F.broadcast(r), "feature").groupBy("feature").agg(
        F.avg(F.when(F.col("v") < F.col("alive_low"), 1.0).otherwise(0.0)).alias("prune_rate")
    )
    overlap = (F.least("alive_high", "dead_high") - F.greatest("alive_low", "dead_low")) >= 0
    return r.withColumn("overlap", overlap).join(d, "feature", "left")


def with_hstar(cat: DataFrame) -> DataFrame:
    """Adds ``hstar``: levels still to go to the shallowest optimum; 0 within .001 of the best."""
    best = cat.agg(F.max("f1").alias("_b"))
    opt = cat.crossJoin(F.broadcast(best)).where(F.col("f1") >= F.col("_b") - 0.001).agg(F.min("depth").alias("_d"))
    j = cat.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(opt))
    h = F.when(F.col("f1") >= F.col("_b") - 0.001, 0).otherwise(F.greatest(F.col("_d") - F.col("depth"), F.lit(0)))
    return j.withColumn("hstar", h).drop("_b", "_d")


def admissible_heuristics(nodes: DataFrame, traces: Sequence[Trace], names: Sequence[str] = NODE_PROPERTIES) -> DataFrame:
    """(criterion, alpha, violations, slack, tightness): largest scale of each value
    that never exceeds the levels to go."""
    wide = project_formulas(nodes, names, traces, keep=["hstar"])
    label = F.array(*[F.lit(text(t, names)) for t in traces])
    long = wide.select("hstar", F.posexplode(F.array(*[F.col(f"v{k}") for k in range(len(traces))])).alias("c", "v")).select(
        "hstar", F.get(label, F.col("c")).alias("criterion"), "v"
    )
    a = long.groupBy("criterion").agg(F.min(F.when(F.col("v") > 1e-12, F.col("hstar") / F.col("v"))).alias("alpha")).where(F.col("alpha").isNotNull())
    h = F.least(F.greatest(F.floor(F.col("alpha") * F.col("v")), F.lit(0)), F.lit(10))
    j = long.join(F.broadcast(a), "criterion").withColumn("h", h)
    return j.groupBy("criterion").agg(
        F.max("alpha").alias("alpha"), F.sum(F.when(F.col("h") > F.col("hstar"), 1).otherwise(0)).alias("violations"),
        F.avg(F.col("hstar") - F.col("h")).alias("slack"), F.avg(F.when(F.col("h") == F.col("hstar"), 1.0).otherwise(0.0)).alias("tightness"),
    )


def _ranges(criterion: Trace, low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of a criterion whose inputs lie between ``low`` and ``high``; unbounded where a step isn't
    a sum, a difference, a maximum or a minimum."""
    a, b = low[criterion[0][2]], high[criterion[0][2]]
    for kind, op, i in criterion[1:]:
        c, d = (low[i], high[i]) if i >= 0 else (None, None)
        if kind == "binary" and op == "-":
            a, b = a - d, b - c
        elif kind == "binary" and op in ("+", "max", "min"):
            f = {"+": np.add, "max": np.maximum, "min": np.minimum}[op]
            a, b = f(a, c), f(b, d)
        else:
            return np.full(len(a), -np.inf), np.full(len(a), np.inf)
    return a, b


def pruned_beam(lab: Labelled, criterion: Trace, direction: str, threshold: float, prevalence: float, depth: int = 3, beam: int = 50, ops="beam"):
    """Beam whose levels keep only nodes that satisfy a learned criterion; when none
    does, the best single features end the search.  Where a criterion reads the AUROC, bounds decide about most nodes and
    the exact AUROC about the others."""
    from lucidform.functions.traces import evaluate, feats
    from lucidform.plans.search import beam_search

    full, own, roots = OpSet(), OpSet.preset(ops) if isinstance(ops, str) else ops, []
    reads_auroc = any("auroc" in NODE_PROPERTIES[i] or NODE_PROPERTIES[i] == "both_missing" for i in feats(criterion))

    def inputs(d: int, f1: np.ndarray, nf: np.ndarray, au: np.ndarray) -> list[np.ndarray]:
        return [np.full(len(f1), float(d)), nf, np.full(len(f1), prevalence), f1, 1 - f1, au, 1 - au, f1 * au, au / np.maximum(nf, 0.01), (1 - f1) * (1 - au)]

    def satisfied(v: np.ndarray) -> np.ndarray:
        return v >= threshold if direction == ">" else v <= threshold

    def survive(scores, d):
        if not scores:
            return scores
        if d == 1:
            roots.extend(sorted(scores, key=lambda s: (-s.f1, text(s.trace, lab.features)))[:beam])
        f1 = np.array([s.f1 for s in scores])
        nf = np.array([float(len(feats(s.trace))) for s in scores])
        au = np.array([s.auroc_low for s in scores])
        ok = satisfied(evaluate(criterion, inputs(d, f1, nf, au), full))
        if reads_auroc:
            top = np.array([s.auroc_high for s in scores])

            def unsure(which: np.ndarray) -> np.ndarray:
                """Decides where bounds do; positions of the others."""
                some = [inputs(d, f1[which], nf[which], x[which]) for x in (au, top)]
                least, most = _ranges(criterion, [np.minimum(*x) for x in zip(*some)], [np.maximum(*x) for x in zip(*some)])
                sure = (least > threshold + SLACK) | (most < threshold - SLACK)  # sums of doubles may differ in their last digits
                ok[which[sure]] = satisfied(least[sure])
                return which[~sure]

            open_ = unsure(np.flatnonzero(au < top))
            if len(open_):
                for c, (low, high) in zip(open_, auroc_bounds(lab, [scores[c].trace for c in open_], own)):
                    au[c], top[c] = max(au[c], low), min(top[c], high)
                open_ = unsure(open_)
            if len(open_):
                for r in exact_scores(lab, [scores[c].trace for c in open_], own).select("cand", "auroc").collect():  # one row per formula
                    au[open_[r["cand"]]] = r["auroc"]
                ok[open_] = satisfied(evaluate(criterion, inputs(d, f1[open_], nf[open_], au[open_]), full))
        kept = [s for s, k in zip(scores, ok) if k]
        return kept or roots

    # a limit on F1 alone never drops a formula for one of lower F1
    return beam_search(lab, depth, beam, ops, level_filter=survive, in_order=criterion == leaf(NODE_PROPERTIES.index("f1")) and direction == ">")

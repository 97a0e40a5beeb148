"""Formula searches: one Spark job chain per level, beam on the driver."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import Trace, evaluate, feats, leaf, project_formulas, text
from lucidform.operators import candidates as cd
from lucidform.operators.ranking import hash_order
from lucidform.operators.scoring import score, with_formula
from lucidform.operators.screening import Score, auroc_at_least, percentile_scores, sample_columns, search_scores
from lucidform.sources.labelled import Labelled, hashed, working_copy

# Beam widths by depth.
FUNNEL = {2: 100, 3: 60, 4: 30, 5: 15, 6: 7, 7: 3}
WIDE = {2: 500, 3: 300, 4: 150}


def _on_working_copy(fn=None, *, rid: bool = False):
    """Run a search on a kept copy of its input, of row identities a hash unless ``rid``; results name the original table."""
    if fn is None:
        return functools.partial(_on_working_copy, rid=rid)

    @functools.wraps(fn)
    def run(lab: Labelled, *args, **kwargs):
        with working_copy(lab if rid or lab.df.storageLevel.useMemory else hashed(lab)) as kept:
            out = fn(kept, *args, **kwargs)
        if isinstance(out, SearchResult):
            out.lab = lab
        return out

    return run


RESULT = "trial int, depth int, formula string, f1 double, direction int, threshold double, n_features int, trace array<struct<kind:string,op:string,feat:int>>"


@dataclass
class SearchResult:
    """What a search found, best first, and how it got there."""

    lab: Labelled
    found: list[tuple[int, int, Score]] = field(default_factory=list)  # trial, depth, score
    tested: int = 0
    mode: str = "beam"
    stopped_at: int = 0
    limited_at: int | None = None  # the first depth at which a budget, not the rule, decided what was kept

    def ranked(self) -> list[tuple[int, int, Score]]:
        return sorted(self.found, key=lambda x: (-x[2].f1, text(x[2].trace, self.lab.features)))

    @property
    def best(self) -> Score:
        return self.ranked()[0][2]

    def convergence(self) -> dict[int, float]:
        """Best F1 reached up to each depth."""
        out: dict[int, float] = {}
        run = 0.0
        for d in sorted({d for _, d, _ in self.found}):
            run = max(run, max(s.f1 for _, dd, s in self.found if dd == d))
            out[d] = run
        return out

    def to_df(self, limit: int | None = None) -> DataFrame:
        rows = self.ranked() if limit is None else self.ranked()[:limit]
        names = self.lab.features
        return self.lab.df.sparkSession.createDataFrame(
            [
                (
                    t, d, text(s.trace, names), float(s.f1), int(s.direction), float(s.threshold), len(feats(s.trace)),
                    [{"kind": k, "op": o, "feat": i} for k, o, i in s.trace],
                )
                for t, d, s in rows
            ],
            RESULT,
        )


def _level_candidates(
    lab: Labelled, beam: Sequence[Trace], ops: OpSet, seen: set[str], allow_self: bool, skip_monotone: bool, ids: Sequence[int] | None
) -> list[Trace]:
    """Distinct children of the beam that were not generated before."""
    spark = lab.df.sparkSession
    names = lab.features
    children = cd.expand(cd.from_traces(spark, beam, names), names, ops, allow_self, skip_monotone)
    if ids is not None:
        children = children.where(F.forall("feats", lambda f: f.isin([int(i) for i in ids])))
    out = []
    for t, row in cd.collect_traces(cd.dedup_canonical(children)):
        if row["canon"] not in seen:
            seen.add(row["canon"])
            out.append(t)
    return out


def _top(scores: Sequence[Score], names: Sequence[str], b: int | None) -> list[Score]:
    return sorted(scores, key=lambda s: (-s.f1, text(s.trace, names)))[:b]


@_on_working_copy
def beam_search(
    lab: Labelled,
    depth: int = 3,
    beam: int | None = 100,
    ops: OpSet | str = "beam",
    schedule: dict[int, int] | None = None,
    ids: Sequence[int] | None = None,
    allow_self: bool = True,
    skip_monotone: bool = False,
    target: float | None = None,
    level_filter: Callable[[list[Score], int], list[Score]] | None = None,
    select: Callable[[list[Score], int, int], list[Score]] | None = None,
    min_auroc: float | None = None,
    sample: list[np.ndarray] | None = None,
    max_tasks: int | None = None,
    in_order: bool = False,
) -> SearchResult:
    """Level-by-level beam.

    ``schedule`` gives the width per depth; ``target`` stops after the first
    level that reaches it, so the depth found is minimal; ``level_filter`` and
    ``select`` replace the survival rule and the ranking.  With ``in_order`` the filter never drops a formula and keeps one
    of lower F1, so that it needs the best of a level only.  Without ``beam`` every formula of a level is kept.
    """
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    sample = sample if sample is not None else sample_columns(lab)
    names = lab.features
    res = SearchResult(lab)
    level = [leaf(i) for i in (ids if ids is not None else range(len(names)))]
    seen = {cd.canonical_text(t, names) for t in level}
    for d in range(1, depth + 1):
        width = (schedule or {}).get(d, beam)
        res.tested += len(level)
        need = None if ((level_filter and not in_order) or select or min_auroc is not None) else width
        scores = search_scores(lab, level, keep=need, ops=ops, sample=sample, max_tasks=max_tasks)
        if min_auroc is not None and d > 1:
            scores = _auroc_at_least(lab, scores, min_auroc, ops)
        if level_filter is not None:
            scores = level_filter(scores, d)
        kept = select(scores, width, d) if select else _top(scores, names, width)
        res.found += [(0, d, s) for s in kept]
        res.stopped_at = d
        if not kept or (target is not None and max(s.f1 for s in kept) >= target):
            break
        if d < depth:
            level = _level_candidates(lab, [s.trace for s in kept], ops, seen, allow_self, skip_monotone, ids)
            if not level:
                break
    return res


def _auroc_at_least(lab: Labelled, scores: list[Score], tau: float, ops: OpSet) -> list[Score]:
    """Keep AUROC >= tau; candidates the bounds cannot decide are decided exactly."""
    keep = [s for s in scores if s.auroc_low >= tau]
    unsure = [s for s in scores if s.auroc_low < tau <= s.auroc_high]
    if unsure:
        keep += [s for s, reached in zip(unsure, auroc_at_least(lab, [s.trace for s in unsure], tau, ops)) if reached]
    return keep


def confirm(lab: Labelled, result: SearchResult, k: int = 20, ops: OpSet | None = None) -> DataFrame:
    """The best k formulas with exact F1, AUROC and data-valued thresholds."""
    top = [s.trace for _, _, s in result.ranked()[:k]]
    return score(lab, top, ops=ops).orderBy(F.desc("f1"), "formula")


# --- phased search ----------------------------------------------------------


@dataclass
class PhasedResult:
    formulas: DataFrame  # formula, phase, f1, threshold, direction
    tested: int
    convergence: dict[int, float]
    ceiling: float
    best: str
    ensemble: float | None = None

    @property
    def gap(self) -> float | None:
        return None if self.ensemble is None else self.ensemble - self.ceiling


@_on_working_copy(rid=True)
def phased_search(
    lab: Labelled,
    ops: OpSet | str = "full",
    top_pairs: int = 30,
    top_singles: int = 8,
    templates: str = "basic",
    ensemble: bool = False,
) -> PhasedResult:
    """Singles, pairs, unary maps of the best pairs, triples of the best singles,
    each with the quick percentile sweep."""
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    spark = lab.df.sparkSession
    names = lab.features

    sample = sample_columns(lab)

    def sweep(traces: Sequence[Trace], phase: Callable[[Trace], int]) -> list[dict]:
        got = with_formula(percentile_scores(lab, traces, ops=ops, sample=sample), lab, traces).collect()  # one row per formula
        phases = {text(t, names): phase(t) for t in traces}
        return [{**r.asDict(), "phase": phases[r["formula"]]} for r in got]

    singles = [leaf(i) for i in range(len(names))]
    pairs = [t for t, _ in cd.collect_traces(cd.pairwise(spark, names, ops))]
    by_text = {text(t, names): t for t in (*singles, *pairs)}
    first = sweep([*singles, *pairs], lambda t: len(t))
    order = lambda rows: sorted(rows, key=lambda r: (-r["f1"], r["formula"]))
    top2 = [by_text[r["formula"]] for r in order([r for r in first if r["phase"] == 2])[:top_pairs]]
    top1 = [by_text[r["formula"]][0][2] for r in order([r for r in first if r["phase"] == 1])[:top_singles]]
    third = [t for t, _ in cd.collect_traces(cd.expand_unary(cd.from_traces(spark, top2, names), ops))] if top2 else []
    fourth = [t for t, _ in cd.collect_traces(cd.triples(spark, names, top1, templates))] if len(top1) >= 3 else []
    mapped = set(third)
    rest = sweep([*third, *fourth], lambda t: 3 if t in mapped else 4) if third or fourth else []
    rows = order(first + rest)
    conv, run = {}, 0.0
    for p in (1, 2, 3, 4):
        mine = [r["f1"] for r in rows if r["phase"] == p]
        if mine:
            run = max(run, *mine)
            conv[p] = run
    cols = ("formula", "phase", "f1", "threshold", "direction")
    table = spark.createDataFrame(
        [tuple(r[c] for c in cols) for r in rows],
        "formula string, phase int, f1 double, threshold double, direction string",
    )
    out = PhasedResult(table, len(rows), conv, rows[0]["f1"], rows[0]["formula"])
    if ensemble:
        from lucidform.plans.evaluation import baseline_cv

        out.ensemble = baseline_cv(lab, "GB", folds=5)
    return out


@_on_working_copy
def ablation(lab: Labelled, ops: OpSet | str = "full", top_pairs: int = 30) -> DataFrame:
    """Ceiling of the phased search with each binary operator removed in turn.

    Every formula is scored once; removing an operator only changes which of
    them count, except for the unary maps of the best pairs, whose parents
    change and are scored together in one further pass.
    """
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    spark = lab.df.sparkSession
    names = lab.features
    singles = [leaf(i) for i in range(len(names))]
    pairs = [t for t, _ in cd.collect_traces(cd.pairwise(spark, names, ops))]
    sample = sample_columns(lab)

    def sweep(traces: Sequence[Trace]) -> dict[str, float]:
        got = with_formula(percentile_scores(lab, traces, ops=ops, sample=sample), lab, traces)
        return {r["formula"]: r["f1"] for r in got.select("formula", "f1").collect()}

    scored = sweep([*singles, *pairs])
    best_singles = sorted(range(len(names)), key=lambda i: (-scored[names[i]], names[i]))[:8]
    triples = (
        [t for t, _ in cd.collect_traces(cd.triples(spark, names, best_singles, "basic"))] if len(names) >= 3 else []
    )
    variants = ["(none)", *ops.binary]
    parents: dict[str, list[Trace]] = {}
    for v in variants:
        ok = [t for t in pairs if t[1][1] != v]
        parents[v] = sorted(ok, key=lambda t: (-scored[text(t, names)], text(t, names)))[:top_pairs]
    unary = {t for v in variants for t in parents[v]}
    maps = [t for t, _ in cd.collect_traces(cd.expand_unary(cd.from_traces(spark, sorted(unary), names), ops))]
    late = sweep([*maps, *triples])
    rows = []
    for v in variants:
        keep = set(parents[v])
        f1s = [scored[text(t, names)] for t in singles]
        f1s += [scored[text(t, names)] for t in pairs if t[1][1] != v]
        f1s += [late[text(t, names)] for t in maps if t[:-1] in keep]
        f1s += [late[text(t, names)] for t in triples]
        rows.append((v, max(f1s)))
    return spark.createDataFrame(rows, "removed string, ceiling double")


# --- variants ---------------------------------------------------------------


def semantic_keys(sample: Sequence[np.ndarray], traces: Sequence[Trace], ops: OpSet, probes: int = 7) -> list[tuple]:
    """Values on a few probe rows, rounded; formulas with equal keys may be the same."""
    rows = [c[:probes] for c in sample]
    with np.errstate(all="ignore"):
        return [tuple(np.round(evaluate(t, rows, ops), 6).tolist()) for t in traces]


def same_values(lab: Labelled, pairs: Sequence[tuple[Trace, Trace]], ops: OpSet, chunk: int = 40) -> list[bool]:
    """Whether two formulas agree to 1e-6 on every row; one pass per chunk of pairs."""
    out = []
    for i in range(0, len(pairs), chunk):
        part = pairs[i : i + chunk]
        wide = project_formulas(lab.df, lab.features, [t for p in part for t in p], ops=ops)
        row = wide.agg(*[F.max((F.abs(F.col(f"v{2 * k}") - F.col(f"v{2 * k + 1}")) > 1e-6).cast("int")).alias(f"d{k}") for k in range(len(part))]).first()
        out += [not row[k] for k in range(len(part))]
    return out


@_on_working_copy(rid=True)
def diverse_beam(
    lab: Labelled,
    depth: int = 3,
    beam: int = 20,
    penalty: float = 0.3,
    min_auroc: float = 0.55,
    ops: OpSet | str = "full",
) -> SearchResult:
    """Beam that drops formulas equal on all rows (those equal on probe rows are
    compared there), prunes by AUROC and trades F1 against correlation with what is already in the beam."""
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    sample = sample_columns(lab)
    state: dict = {"beam": [], "first": {}}

    def choose(scores: list[Score], width: int, d: int) -> list[Score]:
        ranked = _top(scores, lab.features, len(scores))
        fresh, alike = [], []
        for s, key in zip(ranked, semantic_keys(sample, [s.trace for s in ranked], ops)):
            first = state["first"].setdefault(key, s.trace)
            (fresh if first == s.trace else alike).append(s)
        same = same_values(lab, [(s.trace, state["first"][k]) for s, k in zip(alike, semantic_keys(sample, [s.trace for s in alike], ops))], ops)
        fresh += [s for s, drop in zip(alike, same) if not drop]
        # a correlation pass is needed only where the penalty can change the cut
        if not fresh:
            return []
        div = _correlate(lab, [s.trace for s in fresh], state["beam"], ops)
        out = sorted(
            fresh, key=lambda s: (-(s.f1 - penalty * div[s.trace]), text(s.trace, lab.features))
        )[:width]
        state["beam"] = [s.trace for s in out]
        return out

    return beam_search(
        lab, depth, beam, ops, skip_monotone=True, select=choose, min_auroc=min_auroc, sample=sample
    )


def _correlate(lab: Labelled, cands: list[Trace], beam: list[Trace], ops: OpSet) -> dict[Trace, float]:
    """Largest absolute correlations from one pass of cross moments."""
    if not beam:
        return {t: 0.0 for t in cands}
    from lucidform.operators.moments import cross_moments

    return cross_moments(lab, cands, beam, ops)


def subspaces(lab: Labelled, k: int, trials: int, seed: int = 42) -> DataFrame:
    """(trial, feat, name): k features per trial without replacement."""
    spark = lab.df.sparkSession
    f = cd.feature_table(spark, lab.features)
    t = spark.range(trials).select(F.col("id").cast("int").alias("trial"))
    h = hash_order(seed, F.concat_ws(":", "trial", "feat"))
    rn = F.row_number().over(Window.partitionBy("trial").orderBy("_h"))
    return f.crossJoin(t).withColumn("_h", h).withColumn("_r", rn).where(F.col("_r") <= k).drop("_h", "_r")


@_on_working_copy
def fuzzed_search(
    lab: Labelled, k: int, trials: int, depth: int = 3, beam: int = 100, ops: OpSet | str = "beam", seed: int = 42
) -> SearchResult:
    """Beams on random feature subspaces.  The candidates of all trials of a level
    are scored in the same passes; every trial keeps its own beam."""
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    names = lab.features
    picked: dict[int, list[int]] = {}
    for r in subspaces(lab, k, trials, seed).orderBy("trial", "feat").collect():  # trials x k rows
        picked.setdefault(r["trial"], []).append(r["feat"])
    sample = sample_columns(lab)
    res = SearchResult(lab, mode="fuzz")
    levels = {t: [leaf(i) for i in ids] for t, ids in picked.items()}
    seen = {t: {cd.canonical_text(x, names) for x in lv} for t, lv in levels.items()}
    for d in range(1, depth + 1):
        union = sorted({x for lv in levels.values() for x in lv}, key=lambda x: text(x, names))
        res.tested += len(union)
        # a beam of one trial may reach below the overall top, so all are scored
        got = {s.trace: s for s in search_scores(lab, union, keep=None, ops=ops, sample=sample)}
        nxt = {}
        for t, lv in levels.items():
            kept = _top([got[x] for x in lv if x in got], names, beam)
            res.found += [(t, d, s) for s in kept]
            if d < depth:
                nxt[t] = _level_candidates(lab, [s.trace for s in kept], ops, seen[t], True, False, picked[t])
        levels = nxt
    return res


@_on_working_copy
def search(
    lab: Labelled,
    mode: str = "auto",
    target: float = 0.0,
    depth: int = 3,
    max_expansions: int | None = None,
    auroc_threshold: float = 0.55,
    beam: int | None = None,
    ops: OpSet | str = "full",
) -> SearchResult:
    """``strict`` keeps everything, ``fast`` what passes the AUROC limit, ``auto`` is
    strict while the level fits the caller's budget ``max_expansions`` and then
    narrows to it, ``adaptive`` is wide to depth 3 and narrow below.  ``beam`` is a
    width of the caller's.  Where a budget decided, ``limited_at`` tells the depth."""
    ops_ = OpSet.preset(ops) if isinstance(ops, str) else ops
    goal = target if target > 0 else None
    d = len(lab.features)
    branching = d * len(ops_.binary) + len(ops_.unary)
    if mode == "adaptive":
        wide = beam or 100
        schedule = {k: wide if k <= 3 else max(1, wide // (4 ** (k - 3))) for k in range(1, 6)}
        res = beam_search(lab, min(depth, 5), wide, ops_, schedule=schedule, target=goal)
    elif mode == "fast":
        res = beam_search(lab, depth, beam, ops_, target=goal, min_auroc=auroc_threshold)
    elif mode == "strict":
        res = beam_search(lab, depth, beam, ops_, target=goal)
    else:
        if max_expansions is None:
            raise ValueError("auto needs a budget: max_expansions")
        width = beam or max_expansions
        fits = d * branching ** (depth - 1) <= max_expansions
        if not fits:
            strict_depth = max(1, int(np.floor(1 + np.log(max_expansions / d) / np.log(branching))))
            res = beam_search(lab, min(strict_depth, depth), width, ops_, target=goal)
            reached = goal is not None and res.best.f1 >= goal
            if not reached and strict_depth < depth:
                # the wider levels go on from an AUROC-pruned beam
                res = beam_search(
                    lab, depth, max(1, max_expansions // branching), ops_, target=goal, min_auroc=auroc_threshold
                )
                res.limited_at = strict_depth + 1
        else:
            res = beam_search(lab, depth, width, ops_, target=goal)
    res.mode = mode
    return res


@_on_working_copy
def funnel(lab: Labelled, n_rows: int, ops: OpSet | str = "beam", max_depth: int | None = None) -> SearchResult:
    """Deep, narrowing beam: depth by rows per feature, one formula per distinct F1."""
    ratio = n_rows / max(1, len(lab.features))
    depth = 7 if ratio > 10 else 5 if ratio > 5 else 3
    depth = depth if max_depth is None else min(depth, max_depth)

    def by_score(scores: list[Score], width: int, d: int) -> list[Score]:
        out, hit = [], set()
        for s in _top(scores, lab.features, len(scores)):
            if round(s.f1, 5) not in hit:
                hit.add(round(s.f1, 5))
                out.append(s)
        return out[:width]

    return beam_search(lab, depth, 100, ops, schedule=FUNNEL, select=by_score)


@_on_working_copy
def wide_shallow(lab: Labelled, depth: int = 3, ops: OpSet | str = "beam") -> SearchResult:
    return beam_search(lab, depth, 500, ops, schedule=WIDE)


@_on_working_copy
def best_first(lab: Labelled, depth: int = 2, width: int = 50, ops: OpSet | str = "minimal") -> SearchResult:
    """Both argument orders, formulas limited to 2 * depth + 1 nodes, best 20 reported."""
    ops = OpSet.preset(ops) if isinstance(ops, str) else ops
    spark = lab.df.sparkSession
    names = lab.features
    res = SearchResult(lab, mode="best_first")
    level = [leaf(i) for i in range(len(names))]
    seen = {cd.canonical_text(t, names) for t in level}
    sample = sample_columns(lab)
    for d in range(1, depth + 1):
        res.tested += len(level)
        kept = _top(search_scores(lab, level, keep=width, ops=ops, sample=sample), names, width)
        res.found += [(0, d, s) for s in kept]
        if d == depth:
            break
        children = cd.expand_both_orders(cd.from_traces(spark, [s.trace for s in kept], names), names, ops, depth)
        level = []
        for t, row in cd.collect_traces(cd.dedup_canonical(children)):
            if row["canon"] not in seen:
                seen.add(row["canon"])
                level.append(t)
        if not level:
            break
    return res

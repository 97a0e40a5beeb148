"""Composite searches over line items."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import binary, binary_r, leaf, text, unary
from lucidform.operators.candidates import canonical_text
from lucidform.operators.projections import augment, top_pair_products
from lucidform.operators.scoring import SWEEP
from lucidform.plans import search as se
from lucidform.plans import studies as st
from lucidform.plans.registry import query
from lucidform.plans.sqltext import NAMES, sql_formula, sql_percentile_f1, sql_scores, sql_values
from lucidform.sources.labelled import embedded_items, hashed, returned_items, table, working_copy

_EXACT = OpSet({k: OpSet().binary[k] for k in ("+", "-", "*", "max", "hypot")}, {k: OpSet().unary[k] for k in ("sqrt", "sq", "abs")})
_ONE = [leaf(i) for i in range(4)]


def _children(parents, ops, both=False, ids=range(4)):
    """Distinct children up to argument order, alphabetically first text."""
    seen = {canonical_text(t, NAMES) for t in parents}
    out = {}
    for t in parents:
        kids = [binary(t, o, j) for o in ops.binary for j in ids] + [unary(u, t) for u in ops.unary]
        kids += [binary_r(j, o, t) for o in ops.binary for j in ids] if both else []
        for k in kids:
            c = canonical_text(k, NAMES)
            if c not in seen and (c not in out or text(k, NAMES) < text(out[c], NAMES)):
                out[c] = k
    return list(out.values())


_TWO = _children(_ONE, _EXACT)
_DEPTH2 = f"""SELECT 1 AS depth, formula, f1 FROM ({sql_scores(sql_values(_ONE))}) UNION ALL
 SELECT * FROM (SELECT 2 AS depth, formula, f1 FROM ({sql_scores(sql_values(_TWO))}) ORDER BY f1 DESC, formula LIMIT 10)"""


@query("i03_beam_search", _DEPTH2)
def _i03(spark, sf):
    r = se.beam_search(returned_items(spark, sf), 2, 10, _EXACT)
    return r.to_df().select("depth", "formula", "f1")


_OWN = OpSet.of({"mean": lambda a, b: (a + b) / 2.0}, {"cube": lambda x: x * x * x})


@query("u01_user_operators", f"""SELECT 1 AS depth, formula, f1 FROM ({sql_scores(sql_values(_ONE))}) UNION ALL
 SELECT 2 AS depth, formula, f1 FROM ({sql_scores(sql_values(_children(_ONE, _OWN)))})""")
def _u01(spark, sf):
    """Operators that a user gives as Column functions."""
    return se.beam_search(returned_items(spark, sf), 2, None, _OWN).to_df().select("depth", "formula", "f1")


@query("i03_beam_search_depth3")
def _i03b(spark, sf):
    return se.beam_search(returned_items(spark, sf), 3, 20, "beam").to_df(20).select("depth", "formula", "f1", "direction", "threshold")


@query("i06_search_strict", _DEPTH2.replace("LIMIT 10", ""))
def _i06(spark, sf):
    return se.search(returned_items(spark, sf), "strict", depth=2, ops=_EXACT).to_df().select("depth", "formula", "f1")


@query("i06_search_target", f"SELECT 1 AS depth, formula, f1 FROM ({sql_scores(sql_values(_ONE))})")
def _i06t(spark, sf):
    """A target that single features reach: the search stops at depth 1."""
    return se.search(returned_items(spark, sf), "strict", target=0.4, depth=3, ops=_EXACT).to_df().select("depth", "formula", "f1")


@query("i06_search_modes")
def _i06m(spark, sf):
    lab = returned_items(spark, sf)
    rows = []
    for mode, kw in (("fast", {"auroc_threshold": 0.5015, "depth": 2}), ("auto", {"depth": 3, "max_expansions": 300}), ("adaptive", {"depth": 4, "beam": 10})):
        r = se.search(lab, mode, ops="minimal", **kw)
        rows.append((mode, text(r.best.trace, lab.features), float(r.best.f1), r.stopped_at, r.tested))
    return spark.createDataFrame(rows, "mode string, formula string, f1 double, depth int, tested int")


@query("i04_diverse_beam")
def _i04(spark, sf):
    return se.diverse_beam(returned_items(spark, sf), 2, 10, min_auroc=0.501, ops="minimal").to_df().select("depth", "formula", "f1")


def _fuzzed_sql(k: int, trials: int, beam: int, ops: OpSet) -> str:
    """Every trial's features are the k with the least digests; a level keeps the trial's best."""
    parts = []
    for t in range(trials):
        ids = sorted(sorted(range(4), key=lambda i: hashlib.md5(f"42|{t}:{i}".encode()).hexdigest())[:k])
        leaves = [leaf(i) for i in ids]
        for depth, level in ((1, leaves), (2, _children(leaves, ops, ids=ids))):
            parts.append(f"SELECT * FROM (SELECT {t} AS trial, {depth} AS depth, formula, f1 FROM ({sql_scores(sql_values(level))}) ORDER BY f1 DESC, formula LIMIT {beam})")
    return " UNION ALL ".join(parts)


@query("i05_fuzzed_search", _fuzzed_sql(2, 4, 5, OpSet.preset("minimal")))
def _i05(spark, sf):
    return se.fuzzed_search(returned_items(spark, sf), 2, 4, 2, 5, "minimal").to_df().select("trial", "depth", "formula", "f1")


def _phased_sql() -> str:
    """Best of the first two phases of the quick sweep."""
    ops = OpSet.preset("minimal")
    pairs = [binary(leaf(i), o, j) for i in range(4) for j in range(4) if i != j for o in ops.binary]
    a = sql_percentile_f1(sql_values(_ONE), SWEEP)
    b = sql_percentile_f1(sql_values(pairs), SWEEP)
    return f"SELECT 1 AS phase, max(f1) AS best FROM ({a}) UNION ALL SELECT 2, max(f1) FROM ({b})"


@query("i01_phased_search", _phased_sql())
def _i01(spark, sf):
    r = se.phased_search(returned_items(spark, sf), "minimal", 5, 4)
    return r.formulas.groupBy("phase").agg(F.max("f1").alias("best")).where(F.col("phase") <= 2)


@query("i01_phased_search_full")
def _i01f(spark, sf):
    return se.phased_search(returned_items(spark, sf), "full", 30, 8).formulas


@query("i02_ablation")
def _i02(spark, sf):
    return se.ablation(returned_items(spark, sf), "minimal", 5)


@query("i07_autotune")
def _i07(spark, sf):
    cs = [st.Config("raw", ops="minimal", depth=1), st.Config("pls2", ("pls",), 2, 1, "minimal"), st.Config("minimal", ops="minimal")]
    return st.autotune(returned_items(spark, sf), cs, beam=10)


_REG = [*[binary(leaf(i), o, j) for i in range(2) for j in range(2) if i != j for o in ("+", "-", "*", "/", "max", "min", "hypot")]]
_T = "(SELECT l_quantity AS qty, l_discount AS disc, l_extendedprice / 1000.0::DOUBLE AS t FROM lineitem)"


@query(
    "i08_regression_search",
    " UNION ALL ".join(f"SELECT 2 AS phase, '{text(t, ('qty', 'disc'))}' AS formula, round(regr_r2(t, {sql_formula(t, ('qty', 'disc'))}), 6) AS r2 FROM {_T}" for t in _REG),
)
def _i08(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), (F.col("l_extendedprice") / 1000.0).alias("t"))
    r = st.regression_search(d, ("qty", "disc"), "t")
    return r.where((F.col("phase") == 2) & F.col("formula").startswith("(")).select("phase", "formula", F.round("r2", 6).alias("r2"))


_BOTH = _children(_ONE, OpSet.preset("minimal"), both=True)


@query(
    "i09_best_first_search",
    f"SELECT * FROM (SELECT 1 AS depth, formula, f1 FROM ({sql_scores(sql_values(_ONE))}) UNION ALL SELECT 2, formula, f1 FROM ({sql_scores(sql_values(_BOTH))})) ORDER BY f1 DESC, formula LIMIT 20",
)
def _i09(spark, sf):
    """The report of the best 20."""
    return se.best_first(returned_items(spark, sf), 2, 20).to_df(20).select("depth", "formula", "f1")


@query("i10_deep_funnel")
def _i10(spark, sf):
    """As deep as the rows per column allow (7 levels), over raw columns, two components and the best two products."""
    with working_copy(hashed(returned_items(spark, sf))) as lab:  # derived columns are made in every pass
        wide, _ = augment(lab, ["pls"], 2)
        products = {f"{lab.features[t[0][2]]}_{lab.features[t[1][2]]}": F.col(lab.features[t[0][2]]) * F.col(lab.features[t[1][2]]) for _, _, t in top_pair_products(lab, 2)}
        wide = wide.augmented(products)
        return se.funnel(wide, lab.df.count(), "minimal").to_df().select("depth", "formula", "f1")


@query(
    "i11_wide_shallow",
    f"SELECT 1 AS depth, formula, f1 FROM ({sql_scores(sql_values(_ONE))}) UNION ALL SELECT 2, formula, f1 FROM ({sql_scores(sql_values(_children(_ONE, OpSet.preset('minimal'))))})",
)
def _i11(spark, sf):
    return se.wide_shallow(returned_items(spark, sf), 2, "minimal").to_df().select("depth", "formula", "f1")


@query("i13_projection_shootout")
def _i13(spark, sf):
    cs = [st.Config("raw", depth=1, ops="minimal"), st.Config("pca2", ("pca",), 2, 1, "minimal"), st.Config("pls2", ("pls",), 2, 1, "minimal")]
    return st.projection_shootout(returned_items(spark, sf), cs, 2, 5)


_KIDS = [binary(leaf(i), o, j) for o in OpSet.preset("minimal").binary for i in range(4) for j in range(4)] + [unary(u, leaf(i)) for u in OpSet.preset("minimal").unary for i in range(4)]
_FIRST = ", ".join(f"('{text(t, NAMES)}', '{NAMES[t[0][2]]}')" for t in _KIDS)


@query(
    "i14_filter_benchmark",
    f"""WITH good AS (SELECT formula FROM ({sql_scores(sql_values(_ONE))}) WHERE auroc >= 0.5011::DOUBLE),
 k AS (SELECT f1, first IN (SELECT formula FROM good) AS kept FROM ({sql_scores(sql_values(_KIDS))}) s JOIN (VALUES {_FIRST}) n(formula, first) ON s.formula = n.formula)
 SELECT max(f1) = coalesce(max(f1) FILTER (kept), 0) AS same_best, count(*)::INTEGER AS exhaustive, (count(*) FILTER (kept))::INTEGER AS filtered,
  1.0::DOUBLE - (count(*) FILTER (kept))::DOUBLE / greatest(count(*), 1) AS prune_rate FROM k""",
)
def _i14(spark, sf):
    return st.filter_benchmark(returned_items(spark, sf), 0.5011)


@query("i15_ceiling_benchmark")
def _i15(spark, sf):
    wide = embedded_items(spark, sf, size=64)
    return st.ceiling_benchmark({"items": returned_items(spark, sf), "vectors": wide}, "RF", folds=2)


"""Catalogs with lineage and the pruning rules learned from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import Trace, binary, leaf, text, unary
from lucidform.operators import pruning as pr
from lucidform.plans.registry import query
from lucidform.plans.queries_evaluation import urgent
from lucidform.plans.sqltext import ITEMS, NAMES, sql_scores, sql_values
from lucidform.session import written
from lucidform.sources.labelled import returned_items

_OPS = OpSet({k: OpSet().binary[k] for k in ("+", "*", "-")}, {k: OpSet().unary[k] for k in ("sq", "sqrt")})
_SIX = pr.criteria("6")
_lab = returned_items


def _all(size: int, depth: int = 2) -> list[tuple[Trace, Trace | None, int]]:
    """(formula, parent, depth): every formula of ``size`` features, first of equal texts."""
    level: list[tuple[Trace, Trace | None, int]] = [(leaf(i), None, 1) for i in range(size)]
    out = list(level)
    for d in range(2, depth + 1):
        level = [(t, p, d) for p, _, _ in level for t in [binary(p, o, j) for o in _OPS.binary for j in range(size)] + [unary(u, p) for u in _OPS.unary]]
        out += level
    return out


def _cat_sql(names=NAMES, source: str = ITEMS, depth: int = 2) -> str:
    every = _all(len(names), depth)
    nodes = ", ".join(f"('{text(t, names)}', {'NULL' if p is None else repr(text(p, names))}, {d}, {len({i for _, _, i in t if i >= 0})})" for t, p, d in every)
    return f"""(SELECT s.formula, parent, depth, n_features, f1, auroc FROM ({sql_scores(sql_values([t for t, _, _ in every], names, source))}) s
 JOIN (VALUES {nodes}) n(formula, parent, depth, n_features) ON s.formula = n.formula WHERE f1 > 0)"""


_CAT = _cat_sql()
_EPS = 0.00001
_ALIVE = f"""WITH cat AS MATERIALIZED (SELECT * FROM {_CAT}), top AS (SELECT max(f1) AS b FROM cat),
 own AS (SELECT cat.*, CASE WHEN f1 >= b - {_EPS} THEN 1 ELSE 0 END AS a FROM cat, top),
 up AS (SELECT parent AS p, max(a) AS u FROM own WHERE depth = 2 GROUP BY parent),
 nodes AS MATERIALIZED (SELECT formula, parent, depth, n_features, f1, auroc, greatest(a, coalesce(u, 0)) AS alive FROM own LEFT JOIN up ON formula = p AND depth = 1)"""


def _nodes(spark, sf):
    return pr.viability(written(pr.catalog(_lab(spark, sf), 2, _OPS), "catalog"), _EPS)


_LOW = 0.00005  # tells some nodes above the last level of the deeper catalog apart


def _alive3(eps) -> str:
    """Nodes above the last level of the catalog to depth 3, alive or not, for each tolerance."""
    return f"""WITH every AS MATERIALIZED (SELECT * FROM {_cat_sql(depth=3)}), cat AS MATERIALIZED (SELECT * FROM every WHERE parent IS NULL OR parent IN (SELECT formula FROM every)),
 e(eps) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in eps)}),
 own AS (SELECT eps, formula, parent, depth, n_features, f1, auroc, CASE WHEN f1 >= (SELECT max(f1) FROM cat) - eps THEN 1 ELSE 0 END AS a FROM cat, e),
 up2 AS (SELECT eps AS pe, parent AS p, max(a) AS u FROM own WHERE depth = 3 GROUP BY ALL),
 two AS MATERIALIZED (SELECT eps, formula, parent, depth, n_features, f1, auroc, greatest(a, coalesce(u, 0)) AS alive FROM own LEFT JOIN up2 ON eps = pe AND formula = p WHERE depth = 2),
 up1 AS (SELECT eps AS pe, parent AS p, max(alive) AS u FROM two GROUP BY ALL),
 nodes AS MATERIALIZED (SELECT * FROM two UNION ALL SELECT eps, formula, parent, depth, n_features, f1, auroc, greatest(a, coalesce(u, 0)) FROM own LEFT JOIN up1 ON eps = pe AND formula = p WHERE depth = 1)"""


def _deep_nodes(spark, sf):
    """Nodes of the catalog to depth 3 with what criteria are made of."""
    return pr.node_features(pr.viability(written(pr.catalog(_lab(spark, sf), 3, _OPS), "catalog"), _LOW), _prev(spark, sf))


def _prev(spark, sf) -> float:
    return _lab(spark, sf).df.agg(F.avg("y")).first()[0]


@query("i12_exhaustive_catalog", f"SELECT * FROM {_CAT}")
def _i12(spark, sf):
    return pr.catalog(_lab(spark, sf), 2, _OPS)


@query("d07_catalog_lineage", f"SELECT parent, count(*) AS children, max(f1) AS best FROM {_CAT} WHERE parent IS NOT NULL GROUP BY parent")
def _d07(spark, sf):
    return pr.catalog(_lab(spark, sf), 2, _OPS).where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.max("f1").alias("best"))


@query("d08_propagate_alive", f"{_ALIVE} SELECT depth, alive, count(*) AS n FROM nodes GROUP BY ALL")
def _d08(spark, sf):
    return _nodes(spark, sf).groupBy("depth", "alive").agg(F.count(F.lit(1)).alias("n"))


@query("j01_viability", f"{_ALIVE} SELECT formula, alive FROM nodes")
def _j01(spark, sf):
    return _nodes(spark, sf).select("formula", "alive")


_FEAT_SQL = """SELECT *, n_features::DOUBLE AS inputs, 1 - f1 AS f1_missing, 1 - auroc AS auroc_missing, (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FROM lineitem) AS base_rate,
 f1 * auroc AS f1_times_auroc, auroc / greatest(n_features, 0.01::DOUBLE) AS auroc_per_feature, (1 - f1) * (1 - auroc) AS both_missing FROM nodes"""


@query("j02_node_features", f"{_ALIVE} SELECT formula, depth, inputs, round(f1_missing, 8) AS f1_missing, round(auroc_missing, 8) AS auroc_missing, round(base_rate, 8) AS base_rate, round(f1_times_auroc, 8) AS f1_times_auroc, round(auroc_per_feature, 8) AS auroc_per_feature, round(both_missing, 8) AS both_missing FROM ({_FEAT_SQL})")
def _j02(spark, sf):
    d = pr.node_features(_nodes(spark, sf), _prev(spark, sf))
    return d.select("formula", "depth", "inputs", *[F.round(c, 8).alias(c) for c in ("f1_missing", "auroc_missing", "base_rate", "f1_times_auroc", "auroc_per_feature", "both_missing")])


_CRIT_SQL = {"f1": "f1", "auroc": "auroc", "f1_times_auroc": "f1_times_auroc", "auroc_per_feature": "auroc_per_feature", "(f1 + auroc)": "f1 + auroc", "(f1 / inputs)": "f1 / (inputs + 1e-30)"}
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS criterion, {e} AS v, alive FROM feat" for k, e in _CRIT_SQL.items())
_FOUND = f"""feat AS MATERIALIZED ({_FEAT_SQL}), vals AS ({_LONG}),
 cut AS (SELECT criterion, min(v) FILTER (alive = 1) AS low, max(v) FILTER (alive = 1) AS high, count(*) FILTER (alive = 1) AS total_alive, count(*) FILTER (alive = 0) AS total_dead FROM vals GROUP BY criterion),
 cnt AS (SELECT criterion, low, high, total_alive, total_dead, count(*) FILTER (v < low) AS dn, count(*) FILTER (v > high) AS up FROM vals JOIN cut USING (criterion) WHERE alive = 0 GROUP BY ALL),
 found AS (SELECT criterion, CASE WHEN dn >= up THEN '>' ELSE '<' END AS direction, CASE WHEN dn >= up THEN low ELSE high END AS threshold, greatest(dn, up) AS pruned, total_dead, total_alive, greatest(dn, up) / total_dead AS prune_rate FROM cnt WHERE greatest(dn, up) / total_dead > 0.01)"""


def _found(spark, sf):
    return pr.criterion_search(pr.node_features(_nodes(spark, sf), _prev(spark, sf)), _SIX)


@query("j03_criterion_search", f"{_ALIVE}, {_FOUND} SELECT criterion, direction, round(threshold, 8) AS threshold, pruned, total_dead, total_alive, prune_rate FROM found")
def _j03(spark, sf):
    return _found(spark, sf).withColumn("threshold", F.round("threshold", 8))


@query("j03_above_last_level", f"{_alive3([_LOW])}, {_FOUND} SELECT criterion, direction, round(threshold, 8) AS threshold, pruned, total_dead, total_alive, prune_rate FROM found")
def _j03b(spark, sf):
    """Criteria learned where pruning saves work: above the last level of a catalog to depth 3."""
    return pr.criterion_search(_deep_nodes(spark, sf), _SIX, below_depth=3).withColumn("threshold", F.round("threshold", 8))


@query("j03_deep_criteria")
def _j03d(spark, sf):
    """Criteria to depth 3 over node features, all operators, above the last level."""
    return pr.deep_criteria(written(_deep_nodes(spark, sf), "nodes"), below_depth=3)


# the first seven are fixed values: the tolerances swept; the others tell these close formulas apart
_EPSES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.10, 0.000001, 0.00001, 0.00005, 0.0001)


_PARETO = f"""{_alive3(_EPSES)},
 feat AS MATERIALIZED ({_FEAT_SQL}), vals AS ({_LONG.replace(', alive FROM', ', alive, eps FROM')}),
 cut AS (SELECT eps, criterion, min(v) FILTER (alive = 1) AS low, max(v) FILTER (alive = 1) AS high, count(*) FILTER (alive = 1) AS total_alive, count(*) FILTER (alive = 0) AS total_dead FROM vals GROUP BY ALL),
 cnt AS (SELECT eps, criterion, total_alive, total_dead, count(*) FILTER (v < low) AS dn, count(*) FILTER (v > high) AS up FROM vals JOIN cut USING (eps, criterion) WHERE alive = 0 AND total_alive > 0 GROUP BY ALL),
 best AS (SELECT eps, criterion, greatest(dn, up) / total_dead AS prune_rate, total_alive, row_number() OVER (PARTITION BY eps ORDER BY greatest(dn, up) / total_dead DESC, criterion DESC) AS r FROM cnt)
 SELECT eps, criterion, prune_rate, total_alive FROM best WHERE r = 1"""


@query("j04_pareto_sweep", _PARETO)
def _j04(spark, sf):
    return pr.pareto(written(pr.catalog(_lab(spark, sf), 3, _OPS), "catalog"), _prev(spark, sf), _EPSES, _SIX, 3)


@query("j04_alive_by_eps", f"""WITH cat AS MATERIALIZED (SELECT * FROM {_CAT}), e(eps) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in _EPSES)}),
 own AS (SELECT eps, formula, parent, depth, CASE WHEN f1 >= (SELECT max(f1) FROM cat) - eps THEN 1 ELSE 0 END AS a FROM cat, e),
 up AS (SELECT eps, parent AS p, max(a) AS u FROM own WHERE depth = 2 GROUP BY ALL)
 SELECT own.eps, (sum(greatest(a, coalesce(u, 0))))::BIGINT AS alive, count(*) AS nodes FROM own LEFT JOIN up ON own.eps = up.eps AND formula = p AND depth = 1 GROUP BY own.eps""")
def _j04b(spark, sf):
    e = spark.createDataFrame([(x,) for x in _EPSES], "eps double")
    v = pr.viability(written(pr.catalog(_lab(spark, sf), 2, _OPS), "catalog").crossJoin(F.broadcast(e)), by=["eps"])
    return v.groupBy("eps").agg(F.sum("alive").alias("alive"), F.count(F.lit(1)).alias("nodes"))


@query(
    "j05_cross_dataset_check",
    f"""{_ALIVE}, {_FOUND} SELECT criterion, (sum(CASE WHEN alive = 1 AND NOT k THEN 1 ELSE 0 END))::BIGINT AS fn, (sum(CASE WHEN alive = 0 AND NOT k THEN 1 ELSE 0 END))::BIGINT AS tn,
 (sum(CASE WHEN alive = 0 AND k THEN 1 ELSE 0 END))::BIGINT AS fp, (sum(CASE WHEN alive = 1 AND k THEN 1 ELSE 0 END))::BIGINT AS tp, avg(CASE WHEN alive = 0 THEN CASE WHEN k THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END) AS prune_rate,
 sum(CASE WHEN alive = 1 AND NOT k THEN 1 ELSE 0 END) = 0 AS admissible FROM (SELECT criterion, alive, CASE WHEN direction = '>' THEN v >= threshold ELSE v <= threshold END AS k FROM vals JOIN found USING (criterion)) GROUP BY criterion""",
)
def _j05(spark, sf):
    nodes = written(pr.node_features(_nodes(spark, sf), _prev(spark, sf)), "nodes")
    return pr.cross_check(nodes, pr.criterion_search(nodes, _SIX), _SIX)


_ORDERS = "(SELECT o_totalprice AS price, o_custkey::DOUBLE AS cust, month(o_orderdate)::DOUBLE AS month, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS y FROM orders)"
_OTHER = f"""other AS (SELECT criterion, v, alive FROM ({_ALIVE.replace(_CAT, _cat_sql(("price", "cust", "month"), _ORDERS))}, feat AS ({_FEAT_SQL}), vals AS ({_LONG}) SELECT criterion, v, alive FROM vals))"""


@query(
    "j05_second_table",
    f"""{_ALIVE}, {_FOUND}, {_OTHER} SELECT criterion, count(*) FILTER (alive = 1 AND NOT k) AS fn, count(*) FILTER (alive = 0 AND NOT k) AS tn, count(*) FILTER (alive = 0 AND k) AS fp, count(*) FILTER (alive = 1 AND k) AS tp,
 coalesce(avg(CASE WHEN alive = 0 THEN CASE WHEN k THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END), 0) AS prune_rate, count(*) FILTER (alive = 1 AND NOT k) = 0 AS admissible
 FROM (SELECT criterion, alive, CASE WHEN direction = '>' THEN v >= threshold ELSE v <= threshold END AS k FROM other JOIN found USING (criterion)) GROUP BY criterion""",
)
def _j05b(spark, sf):
    """Criteria learned on line items, checked on the catalog of urgent orders."""
    found = pr.criterion_search(pr.node_features(_nodes(spark, sf), _prev(spark, sf)), _SIX)
    orders = urgent(spark, sf)
    other = pr.viability(written(pr.catalog(orders, 2, _OPS), "catalog"), _EPS)
    return pr.cross_check(pr.node_features(other, orders.df.agg(F.avg("y")).first()[0]), found, _SIX)


@query(
    "j06_meta_ablation",
    f"""{_ALIVE}, feat AS ({_FEAT_SQL}), vals AS (SELECT alive, 'f1' AS feature, f1 AS v FROM feat UNION ALL SELECT alive, 'auroc', auroc FROM feat UNION ALL SELECT alive, 'inputs', inputs FROM feat),
 r AS (SELECT feature, min(v) FILTER (alive = 1) AS alive_low, max(v) FILTER (alive = 1) AS alive_high, min(v) FILTER (alive = 0) AS dead_low, max(v) FILTER (alive = 0) AS dead_high FROM vals GROUP BY feature)
 SELECT r.*, least(alive_high, dead_high) - greatest(alive_low, dead_low) >= 0 AS overlap, p AS prune_rate FROM r JOIN (SELECT feature, avg(CASE WHEN v < alive_low THEN 1.0::DOUBLE ELSE 0 END) AS p FROM vals JOIN r USING (feature) WHERE alive = 0 GROUP BY feature) USING (feature)""",
)
def _j06(spark, sf):
    return pr.feature_ranges(pr.node_features(_nodes(spark, sf), _prev(spark, sf)), ["f1", "auroc", "inputs"])


@query("j07_hstar", f"WITH cat AS MATERIALIZED (SELECT * FROM {_CAT}), b AS (SELECT max(f1) AS b FROM cat), o AS (SELECT min(depth) AS d FROM cat, b WHERE f1 >= b - 0.001) SELECT formula, CASE WHEN f1 >= b - 0.001 THEN 0 ELSE greatest(d - depth, 0) END AS hstar FROM cat, b, o")
def _j07(spark, sf):
    return pr.with_hstar(pr.catalog(_lab(spark, sf), 2, _OPS)).select("formula", "hstar")


_HEUR = f"""WITH cat AS MATERIALIZED (SELECT * FROM {_CAT}), b AS (SELECT max(f1) AS b FROM cat), o AS (SELECT min(depth) AS d FROM cat, b WHERE f1 >= b - 0.001),
 nodes AS MATERIALIZED (SELECT cat.*, CASE WHEN f1 >= b - 0.001 THEN 0 ELSE greatest(d - depth, 0) END AS alive FROM cat, b, o),
 feat AS MATERIALIZED ({_FEAT_SQL}), vals AS MATERIALIZED ({_LONG}),
 scale AS (SELECT criterion, min(alive / v) FILTER (v > 1e-12) AS alpha FROM vals GROUP BY criterion HAVING alpha IS NOT NULL),
 h AS (SELECT criterion, alpha, alive AS hstar, least(greatest(floor(alpha * v), 0), 10) AS h FROM vals JOIN scale USING (criterion))
 SELECT criterion, max(alpha) AS alpha, count(*) FILTER (h > hstar) AS violations, avg(hstar - h) AS slack, avg(CASE WHEN h = hstar THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tightness FROM h GROUP BY criterion"""


@query("j07_admissible_heuristics", _HEUR)
def _j07b(spark, sf):
    nodes = pr.node_features(pr.with_hstar(pr.catalog(_lab(spark, sf), 2, _OPS)), _prev(spark, sf))
    return pr.admissible_heuristics(nodes, _SIX)


@query("j08_pruned_beam")
def _j08(spark, sf):
    """Learn a criterion on a catalog to depth 2, then search one level deeper with it."""
    lab, prev = _lab(spark, sf), _prev(spark, sf)
    by_text = {text(t, pr.NODE_PROPERTIES): t for t in _SIX}
    best = _found(spark, sf).orderBy(F.desc("prune_rate"), "criterion").first()
    if best is None:
        crit, direction, threshold = by_text["f1"], ">", 0.0
    else:
        crit, direction, threshold = by_text[best["criterion"]], best["direction"], best["threshold"]
    return pr.pruned_beam(lab, crit, direction, threshold, prev).to_df().select("depth", "formula", "f1")



"""Column and row selection, candidate generation and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import Trace, binary, leaf, project_formulas, text, triple_templates, unary
from lucidform.operators import candidates as cd
from lucidform.operators import folds
from lucidform.operators.scoring import long_values, score, with_formula
from lucidform.operators.screening import exact_scores
from lucidform.plans.registry import query
from lucidform.plans.search import subspaces
from lucidform.plans.sqltext import ENTROPY_SQL, ITEMS, NAMES, binned_sql, sql_formula, sql_scores, sql_values
from lucidform.sources.labelled import Labelled, returned_items, table, working_copy

RID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
SINGLES = [leaf(i) for i in range(4)]


def _pair_traces(op: str, self_: bool = False) -> list[Trace]:
    return [binary(leaf(i), op, j) for i in range(4) for j in range(4) if self_ or i != j]


@query("c01_select_features", f"SELECT y, sum(qty) AS qty, count(DISTINCT disc) AS n_disc FROM {ITEMS} GROUP BY y")
def _c01(spark, sf):
    lab = returned_items(spark, sf).select_features([0, 2])
    return lab.df.groupBy("y").agg(F.sum(lab.features[0]).alias("qty"), F.count_distinct(lab.features[1]).alias("n_disc"))


def _subspace_sql(k: int, trials: int) -> str:
    return f"""SELECT trial::INTEGER AS trial, feat::INTEGER AS feat, name FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY md5('42|' || trial || ':' || feat)) AS r
 FROM range({trials}) t(trial), (VALUES (0, 'qty'), (1, 'price'), (2, 'disc'), (3, 'tax')) f(feat, name)) WHERE r <= {k}"""


@query(
    "c02_random_subspace",
    f"""SELECT trial, feat, name, CASE name WHEN 'qty' THEN a WHEN 'price' THEN b WHEN 'disc' THEN c ELSE d END AS n_distinct FROM ({_subspace_sql(2, 6)}),
 (SELECT count(DISTINCT qty) AS a, count(DISTINCT price) AS b, count(DISTINCT disc) AS c, count(DISTINCT tax) AS d FROM {ITEMS})""",
)
def _c02(spark, sf):
    lab = returned_items(spark, sf)
    v = long_values(lab, SINGLES).groupBy(F.col("cand").alias("feat")).agg(F.count_distinct("v").alias("n_distinct"))
    return subspaces(lab, 2, 6).join(v, "feat")


@query("c03_top_features_by_f1", f"SELECT formula, f1 FROM ({sql_scores(sql_values(SINGLES))}) ORDER BY f1 DESC, formula LIMIT 2")
def _c03(spark, sf):
    return score(returned_items(spark, sf), SINGLES).select("formula", "f1").orderBy(F.desc("f1"), "formula").limit(2)


@query("c04_top_features_by_variance", f"SELECT name, round(v, 4) AS variance FROM (UNPIVOT (SELECT var_pop(qty) AS qty, var_pop(price / 1000) AS price, var_pop(disc) AS disc, var_pop(tax) AS tax FROM {ITEMS}) ON qty, price, disc, tax INTO NAME name VALUE v) ORDER BY v DESC LIMIT 3")
def _c04(spark, sf):
    lab = returned_items(spark, sf)
    d = lab.df.withColumn("price", F.col("price") / 1000)
    v = d.agg(*[F.var_pop(f).alias(f) for f in lab.features]).unpivot([], list(lab.features), "name", "v")
    return v.orderBy(F.desc("v")).limit(3).select("name", F.round("v", 4).alias("variance"))


def _mi_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{g}' AS feature, {ENTROPY_SQL.format(k=g)} + {ENTROPY_SQL.format(k='y')} - {ENTROPY_SQL.format(k=g + ', y')} AS mi" for g in ("qty", "price", "disc", "tax"))
    return f"""WITH o AS MATERIALIZED (SELECT * FROM {binned_sql()}), m AS (SELECT feature, greatest(mi, 0) AS mi FROM ({each})),
 k AS (SELECT *, mi >= 0.1::DOUBLE * max(mi) OVER () AS hit FROM m)
 SELECT feature, round(mi, 6) AS mi FROM k WHERE hit OR (SELECT count(*) FROM k WHERE hit) < 3"""


@query("c05_mi_filter", _mi_sql())
def _c05(spark, sf):
    from lucidform.operators.information import informative_features

    return informative_features(returned_items(spark, sf))


_DEAD = _pair_traces("+", True) + _pair_traces("*", True)


@query(
    "c06_drop_dead_features",
    f"""SELECT name FROM (SELECT name, max(auroc) AS a FROM ({sql_scores(sql_values(_DEAD))}), (VALUES ('qty'), ('price'), ('disc'), ('tax')) f(name)
 WHERE formula LIKE '% ' || name || ')' OR formula LIKE '(' || name || ' %' GROUP BY name) WHERE a < 0.5019::DOUBLE""",
)
def _c06(spark, sf):
    """Features that no pair formula lifts above the AUROC limit."""
    lab = returned_items(spark, sf)
    with working_copy(lab) as kept:
        s = with_formula(exact_scores(kept, _DEAD), lab, _DEAD)
    used = spark.createDataFrame([(text(t, lab.features), lab.features[i]) for t in _DEAD for i in {t[0][2], t[1][2]}], "formula string, name string")
    return s.join(F.broadcast(used), "formula").groupBy("name").agg(F.max("auroc").alias("a")).where(F.col("a") < 0.5019).select("name")


_GUARD = [leaf(0), binary(leaf(0), "-", 0), binary(leaf(1), "/", 1), binary(leaf(2), "-", 2)]


@query("c07_constant_guard", f"SELECT formula, f1, auroc FROM ({sql_scores(sql_values(_GUARD))})")
def _c07(spark, sf):
    return score(returned_items(spark, sf), _GUARD).select("formula", "f1", "auroc")


@query("c08_auroc_prune", f"SELECT formula, auroc FROM ({sql_scores(sql_values(_pair_traces('*')))}) WHERE auroc >= 0.5015::DOUBLE")
def _c08(spark, sf):
    return score(returned_items(spark, sf), _pair_traces("*")).where(F.col("auroc") >= 0.5015).select("formula", "auroc")


@query("c09_min_score_filter", f"SELECT formula, f1 FROM ({sql_scores(sql_values(_pair_traces('-')))}) WHERE f1 > 0.3::DOUBLE")
def _c09(spark, sf):
    return score(returned_items(spark, sf), _pair_traces("-")).where(F.col("f1") > 0.3).select("formula", "f1")


@query("c10_valid_mask", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type <> 'error' AND NOT isnan(value) GROUP BY event_type")
def _c10(spark, sf):
    bad = (F.col("event_type") == "error") | F.isnan("value")
    return table(spark, sf, "events").where(~bad).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def rules(spark) -> dict:
    """Named predicates over order-level features."""
    k, g, q = F.col("lines"), F.col("disc"), F.col("ratio")
    return {
        "lines<=3": k <= 3,
        "lines<=2": k <= 2,
        "disc>0.07": g > 0.07,
        "disc>0.06": g > 0.06,
        "ratio>10": q > 10,
        "ratio>2": q > 2,
        "lines>=5": k >= 5,
        "lines<=3_AND_disc>0.06": (k <= 3) & (g > 0.06),
        "lines<=3_AND_ratio>2": (k <= 3) & (q > 2),
        "ratio_2_10": (q > 2) & (q < 10),
        "combo": (k >= 2) & (g > 0.02) & (g < 0.08) & (q > 2),
    }


RULE_SQL = {
    "lines<=3": "lines <= 3",
    "lines<=2": "lines <= 2",
    "disc>0.07": "disc > 0.07::DOUBLE",
    "disc>0.06": "disc > 0.06::DOUBLE",
    "ratio>10": "ratio > 10",
    "ratio>2": "ratio > 2",
    "lines>=5": "lines >= 5",
    "lines<=3_AND_disc>0.06": "lines <= 3 AND disc > 0.06::DOUBLE",
    "lines<=3_AND_ratio>2": "lines <= 3 AND ratio > 2",
    "ratio_2_10": "ratio > 2 AND ratio < 10",
    "combo": "lines >= 2 AND disc > 0.02::DOUBLE AND disc < 0.08::DOUBLE AND ratio > 2",
}
ORDER_SQL = """(SELECT o_orderkey, o_orderstatus AS scenario, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS y, count(*) AS lines, max(l_discount) AS disc,
 max(l_extendedprice) / min(l_extendedprice) AS ratio FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def order_features(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.max("l_discount").alias("disc"), (F.max("l_extendedprice") / F.min("l_extendedprice")).alias("ratio")
    )
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("scenario"), F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0).alias("y")
    )
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("c11_rule_set", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n, (sum(y))::BIGINT AS positives FROM {ORDER_SQL} WHERE {e}" for n, e in RULE_SQL.items()))
def _c11(spark, sf):
    d = order_features(spark, sf)
    long = d.select("y", F.explode(F.array(*[F.when(e, F.lit(n)) for n, e in rules(spark).items()])).alias("rule")).where(F.col("rule").isNotNull())
    return long.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


def _rows_with_id(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("rid", F.col("o_orderkey").cast("string"))


@query("c12_sample_per_stratum", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey)) AS r FROM orders) WHERE r <= 25")
def _c12(spark, sf):
    return folds.sample_per_stratum(_rows_with_id(spark, sf), ["o_orderstatus"], 25).select("o_orderkey", "o_orderstatus")


@query("c13_sample_n", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey) LIMIT 50")
def _c13(spark, sf):
    return folds.sample_n(_rows_with_id(spark, sf), 50).select("o_orderkey")


@query("c13_every_kth", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS r FROM orders) WHERE (r - 1) % 7 = 0")
def _c13b(spark, sf):
    return folds.every_kth(_rows_with_id(spark, sf), 7).select("o_orderkey")


@query("c14_extreme_filter", f"SELECT scenario, count(*) AS n, (sum(y))::BIGINT AS positives FROM {ORDER_SQL} WHERE lines = (SELECT min(lines) FROM {ORDER_SQL}) GROUP BY scenario")
def _c14(spark, sf):
    d = order_features(spark, sf)
    low = d.agg(F.min("lines").alias("lines"))
    return d.join(F.broadcast(low), "lines", "left_semi").groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query(
    "c14_fallback_filter",
    f"""SELECT o_orderkey, lines FROM {ORDER_SQL} WHERE CASE WHEN (SELECT count(*) FROM {ORDER_SQL} WHERE lines <= 0) > 0 THEN lines <= 0 ELSE lines <= 1 END""",
)
def _c14b(spark, sf):
    """Rows within a first limit, or within a second one when there are none."""
    d = order_features(spark, sf)
    any_ = d.agg(F.max(F.when(F.col("lines") <= 0, 1).otherwise(0)).alias("_any"))
    keep = F.when(F.col("_any") == 1, F.col("lines") <= 0).otherwise(F.col("lines") <= 1)
    return d.crossJoin(F.broadcast(any_)).where(keep).select("o_orderkey", "lines")


@query("c15_augment", f"SELECT y, round(avg(qty * disc), 6) AS mean_p, round(max(ln(price)), 6) AS max_l, count(*) AS n FROM {ITEMS} GROUP BY y")
def _c15(spark, sf):
    lab = returned_items(spark, sf).augmented({"p": F.col("qty") * F.col("disc"), "l": F.ln("price")})
    assert lab.features == ("qty", "price", "disc", "tax", "p", "l")
    return lab.df.groupBy("y").agg(F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.max("l"), 6).alias("max_l"), F.count(F.lit(1)).alias("n"))


@query("c16_encode_scenario", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, count(*) AS n FROM orders GROUP BY 1")
def _c16(spark, sf):
    m = F.create_map(F.lit("F"), F.lit(1), F.lit("O"), F.lit(2))
    return table(spark, sf, "orders").groupBy(F.coalesce(F.try_element_at(m, F.col("o_orderstatus")), F.lit(0)).alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- candidate generation: every generated formula is evaluated over the table ----


def _evaluated(lab: Labelled, cands: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Generated candidates with their smallest and largest value over all rows."""
    got = cd.collect_traces(cands)
    traces = [t for t, _ in got]
    parts = None
    for i in range(0, len(traces), 64):
        chunk = traces[i : i + 64]
        wide = project_formulas(lab.df, lab.features, chunk)
        agg = wide.agg(*[F.min(f"v{k}").alias(f"a{k}") for k in range(len(chunk))], *[F.max(f"v{k}").alias(f"b{k}") for k in range(len(chunk))])
        cells = [F.struct(F.lit(text(t, lab.features)).alias("formula"), F.col(f"a{k}").alias("low"), F.col(f"b{k}").alias("high")) for k, t in enumerate(chunk)]
        p = agg.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        parts = p if parts is None else parts.unionByName(p)
    return parts.join(F.broadcast(cands.select("formula", "depth", "n_features", *extra)), "formula")


def _generated_sql(traces: list[Trace], depth: int | None = None) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{text(t, NAMES)}' AS formula, min({sql_formula(t)}) AS low, max({sql_formula(t)}) AS high, {len(t)} AS depth, {len({i for _, _, i in t if i >= 0})} AS n_features FROM src"
        for t in traces
    )
    return f"WITH src AS MATERIALIZED (SELECT * FROM {ITEMS}) {rows}"


_FULL = OpSet.preset("full")
_EXACT_UNARY = ["sqrt", "sq", "neg", "abs"]
_SOME = OpSet({k: _FULL.binary[k] for k in ("+", "*", "min")}, {k: _FULL.unary[k] for k in _EXACT_UNARY})


@query("d01_candidates_leaf", _generated_sql(SINGLES))
def _d01(spark, sf):
    lab = returned_items(spark, sf)
    return _evaluated(lab, cd.leaves(spark, lab.features))


_D2 = [binary(leaf(i), op, j) for i in range(4) for j in range(4) if i != j for op in _FULL.binary]


@query("d02_candidates_pairwise", _generated_sql(_D2))
def _d02(spark, sf):
    lab = returned_items(spark, sf)
    return _evaluated(lab, cd.pairwise(spark, lab.features, _FULL))


@query("d02_candidates_pairwise_self", _generated_sql([binary(leaf(i), op, j) for i in range(4) for j in range(4) for op in _SOME.binary]))
def _d02b(spark, sf):
    lab = returned_items(spark, sf)
    return _evaluated(lab, cd.pairwise(spark, lab.features, _SOME, allow_self=True))


_TOP = [binary(leaf(0), "*", 1), binary(leaf(2), "+", 3), binary(leaf(1), "min", 0)]


@query("d03_candidates_unary_of_topk", _generated_sql([unary(u, t) for t in _TOP for u in _EXACT_UNARY]))
def _d03(spark, sf):
    lab = returned_items(spark, sf)
    return _evaluated(lab, cd.expand_unary(cd.from_traces(spark, _TOP, lab.features), _SOME))


@query(
    "d04_candidates_triples",
    _generated_sql([b(*ids) for ids in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)) for b in triple_templates("basic").values()]),
)
def _d04(spark, sf):
    lab = returned_items(spark, sf)
    return _evaluated(lab, cd.triples(spark, lab.features, [0, 1, 2, 3]))


_BEAM = [leaf(1), binary(leaf(0), "*", 2)]


@query("d05_expand_beam", _generated_sql([binary(t, op, j) for t in _BEAM for op in _SOME.binary for j in range(4)] + [unary(u, t) for t in _BEAM for u in _EXACT_UNARY]))
def _d05(spark, sf):
    lab = returned_items(spark, sf)
    return _evaluated(lab, cd.expand(cd.from_traces(spark, _BEAM, lab.features), lab.features, _SOME))


def _d6_traces() -> list[Trace]:
    from lucidform.functions.traces import binary_r

    out = [binary(t, op, j) for t in _BEAM for op in _SOME.binary for j in range(4)]
    out += [binary_r(j, op, t) for t in _BEAM for op in _SOME.binary for j in range(4)]
    out += [unary(u, t) for t in _BEAM for u in _EXACT_UNARY]
    nodes = lambda t: sum(2 if k.startswith("binary") else 1 for k, _, _ in t)
    seen, keep = set(), []
    for t in out:
        if nodes(t) <= 5 and text(t, NAMES) not in seen:
            seen.add(text(t, NAMES))
            keep.append(t)
    return keep


@query("d06_expand_both_orders", _generated_sql(_d6_traces()))
def _d06(spark, sf):
    lab = returned_items(spark, sf)
    c = cd.expand_both_orders(cd.from_traces(spark, _BEAM, lab.features), lab.features, _SOME, 2)
    return _evaluated(lab, cd.dedup_formula(c))


@query(
    "d09_dedup_formula",
    _generated_sql([t for t in [binary(leaf(i), op, j) for i in range(4) for j in range(4) if i != j for op in _SOME.binary] if text(t, NAMES) not in {"(qty + price)", "(price min tax)"}]),
)
def _d09(spark, sf):
    lab = returned_items(spark, sf)
    seen = cd.from_traces(spark, [binary(leaf(0), "+", 1), binary(leaf(1), "min", 3)], lab.features)
    c = cd.pairwise(spark, lab.features, _SOME)
    return _evaluated(lab, cd.dedup_formula(c.unionByName(c), seen))


@query(
    "d10_dedup_canonical",
    "WITH d AS (" + " UNION ALL ".join(
        f"SELECT '{text(binary(leaf(min((i, j), key=lambda x: NAMES[x])), op, max((i, j), key=lambda x: NAMES[x])), NAMES)}' AS formula, min({sql_formula(binary(leaf(i), op, j))}) AS low, 2::BIGINT AS copies FROM {ITEMS}"
        for i in range(4) for j in range(i + 1, 4) for op in _SOME.binary
    ) + ") SELECT * FROM d",
)
def _d10(spark, sf):
    lab = returned_items(spark, sf)
    c = cd.pairwise(spark, lab.features, _SOME)
    n = c.groupBy("canon").agg(F.count(F.lit(1)).alias("copies"))
    d = cd.dedup_canonical(c).join(n, "canon")
    return _evaluated(lab, d, ["copies"]).select("formula", "low", "copies")


@query(
    "d11_dedup_semantic",
    f"""WITH probe AS MATERIALIZED (SELECT rid, qty, price, disc, tax FROM {ITEMS} ORDER BY md5('0|' || rid), qty, price, disc, tax LIMIT 7),
 v AS ({" UNION ALL ".join(f"SELECT '{text(t, NAMES)}' AS formula, list(round({sql_formula(t)}, 6) ORDER BY md5('0|' || rid), qty, price, disc, tax) AS key FROM probe" for t in _pair_traces("+") + _pair_traces("max") + _pair_traces("diff_sq"))})
 SELECT min(formula) AS formula, count(*) AS same FROM v GROUP BY key""",
)
def _d11(spark, sf):
    """Formulas with equal values on seven probe rows count as one."""
    lab = returned_items(spark, sf)
    traces = _pair_traces("+") + _pair_traces("max") + _pair_traces("diff_sq")
    from lucidform.operators.ranking import hash_order

    probe = lab.df.withColumn("_h", hash_order(0, "rid")).orderBy("_h", *lab.features).limit(7)
    wide = project_formulas(probe, lab.features, traces, keep=["_h", *lab.features])
    names = F.array(*[F.lit(text(t, lab.features)) for t in traces])
    long = wide.select("_h", *lab.features, F.posexplode(F.array(*[F.col(f"v{k}") for k in range(len(traces))])).alias("c", "v"))
    key = F.transform(F.array_sort(F.collect_list(F.struct("_h", *lab.features, F.round("v", 6).alias("v")))), lambda s: s["v"])
    k = long.groupBy("c").agg(F.md5(F.array_join(key, "|")).alias("key"))
    return k.select(F.get(names, F.col("c")).alias("formula"), "key").groupBy("key").agg(F.min("formula").alias("formula"), F.count(F.lit(1)).alias("same")).drop("key")


@query(
    "d12_dedup_by_score",
    f"SELECT formula, f1 FROM (SELECT *, row_number() OVER (PARTITION BY round(f1, 5) ORDER BY f1 DESC, formula) AS r FROM ({sql_scores(sql_values(_pair_traces('*') + _pair_traces('max')))})) WHERE r = 1",
)
def _d12(spark, sf):
    s = score(returned_items(spark, sf), _pair_traces("*") + _pair_traces("max"))
    return s.groupBy(F.round("f1", 5).alias("r")).agg(F.min_by(F.struct("formula", "f1"), F.struct(-F.col("f1"), F.col("formula"))).alias("b")).select("b.*")


@query(
    "d16_eps_cross",
    """SELECT eps, len(list_filter(list_transform(embedding, lambda x: abs(x::DOUBLE)), lambda x: x > eps))::INTEGER AS k, count(*) AS n
 FROM embeddings, (VALUES (1e-1), (5e-2), (1e-2)) e(eps) GROUP BY ALL""",
)
def _d16(spark, sf):
    eps = spark.createDataFrame([(0.1,), (0.05,), (0.01,)], "eps double")
    e = table(spark, sf, "embeddings").crossJoin(F.broadcast(eps))
    return e.groupBy("eps", F.size(F.filter("embedding", lambda x: F.abs(x.cast("double")) > F.col("eps"))).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("d15_attach_names", "SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def _d15(spark, sf):
    n, r, c = (table(spark, sf, t) for t in ("nation", "region", "customer"))
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers")
    )


@query(
    "d17_range_bin_join",
    "SELECT lo, hi, count(*) AS n FROM lineitem JOIN (SELECT i * 5.0::DOUBLE AS lo, i * 5.0::DOUBLE + 5 AS hi FROM range(11) r(i)) ON l_quantity >= lo AND l_quantity < hi GROUP BY ALL",
)
def _d17(spark, sf):
    """Equal-width bins by arithmetic: no non-equi join."""
    lo = F.floor(F.col("l_quantity") / 5.0) * F.lit(5.0)
    return table(spark, sf, "lineitem").groupBy(lo.alias("lo"), (lo + 5.0).alias("hi")).agg(F.count(F.lit(1)).alias("n"))



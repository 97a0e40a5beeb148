"""Folds, cross-validation, model comparison and projections."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from lucidform.functions.formulas import BINARY, UNARY, OpSet
from lucidform.functions.traces import binary, leaf, replay, unary
from lucidform.operators import projections as pj
from lucidform.operators.folds import fold_split, holdout, stratified_folds
from lucidform.operators.metrics import paired_compare
from lucidform.operators.scoring import score
from lucidform.plans import evaluation as ev
from lucidform.plans import search as se
from lucidform.plans.registry import query
from lucidform.plans.sqltext import ITEMS, sql_scores, sql_values
from lucidform.session import checkpoint_dir
from lucidform.sources.labelled import Labelled, embedded_items, load_labelled, returned_items, table

# urgent orders: one row per order, unique identity
_ORD = "(SELECT o_orderkey::VARCHAR AS rid, o_totalprice AS price, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS y, o_orderstatus FROM orders)"


def urgent(spark, sf) -> Labelled:
    o = table(spark, sf, "orders")
    return load_labelled(
        o, {"price": F.col("o_totalprice"), "cust": F.col("o_custkey"), "month": F.month("o_orderdate")},
        F.col("o_orderpriority").startswith("1"), F.col("o_orderkey").cast("string"), [F.col("o_orderstatus")],
    )


def _fold_sql(k: int, repeats: int) -> str:
    return f"(SELECT *, ((row_number() OVER (PARTITION BY repeat, y ORDER BY md5('42|' || repeat || '/' || rid)) - 1) % {k})::INTEGER AS fold FROM {_ORD}, (SELECT i::INTEGER AS repeat FROM range({repeats}) r(i)))"


@query("f03_stratified_folds", f"SELECT repeat, y, fold, count(*) AS n, sum(price)::DECIMAL(20,2)::DOUBLE AS total FROM {_fold_sql(5, 2)} GROUP BY repeat, y, fold")
def _f03(spark, sf):
    d = stratified_folds(urgent(spark, sf).df, 5, 2)
    return d.groupBy("repeat", "y", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("total"))


@query("l01_repeated_stratified_kfold", f"SELECT repeat, fold, rid FROM {_fold_sql(5, 3)}")
def _l01(spark, sf):
    return stratified_folds(urgent(spark, sf).df, 5, 3).select("repeat", "fold", "rid")


@query("l01_twenty_by_five", f"SELECT repeat, fold, y, count(*) AS n, min(rid) AS least, max(rid) AS most FROM {_fold_sql(5, 20)} GROUP BY repeat, fold, y")
def _l01b(spark, sf):
    """Twenty repeats of five folds, from one sort of identities."""
    d = stratified_folds(urgent(spark, sf).df.select("rid", "y"), 5, 20)
    return d.groupBy("repeat", "fold", "y").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("least"), F.max("rid").alias("most"))


@query("d13_fold_join", f"SELECT fold AS held, 'train' AS part, count(*) AS n, (sum(y))::BIGINT AS positives FROM (SELECT a.y, f.fold FROM {_fold_sql(4, 1)} a, range(4) f(fold) WHERE a.fold <> f.fold) GROUP BY fold UNION ALL SELECT fold, 'test', count(*), (sum(y))::BIGINT FROM {_fold_sql(4, 1)} GROUP BY fold")
def _d13(spark, sf):
    a = stratified_folds(urgent(spark, sf).df, 4)
    out = None
    for f in range(4):
        for name, part in zip(("train", "test"), fold_split(a, f)):
            d = part.agg(F.lit(f).cast("long").alias("held"), F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
            out = d if out is None else out.unionByName(d)
    return out


@query("d14_model_vs_baseline", """WITH a AS (SELECT l_suppkey AS k, avg(l_discount) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY k), b AS (SELECT l_suppkey AS k, avg(l_discount) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY k)
 SELECT count(*) AS n, round(avg(b), 8) AS mean, round(avg(a - b), 8) AS diff, CASE WHEN avg(a - b) > 0 THEN 'ahead' ELSE 'behind' END AS dir FROM a JOIN b USING (k)""")
def _d14(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda v, n: li.where(F.col("l_returnflag") == v).groupBy("l_suppkey").agg(F.avg("l_discount").alias(n))
    c = paired_compare(side("R", "a").join(side("A", "b"), "l_suppkey"), "a", "b")
    return c.select("n", F.round("mean", 8).alias("mean"), F.round("diff", 8).alias("diff"), "dir")


@query("l02_fair_cv")
def _l02(spark, sf):
    """Beam per fold on training rows with PLS columns, tested on held-out rows."""
    return ev.fair_cv(returned_items(spark, sf), folds=4, repeats=1, depth=2, beam=10, pls=2)


_SMALL = OpSet({k: BINARY[k] for k in ("+", "*")}, {"sq": UNARY["sq"]})
_SMALL_TRACES = [leaf(i) for i in range(4)] + [binary(leaf(i), o, j) for o in _SMALL.binary for i in range(4) for j in range(4)] + [unary("sq", leaf(i)) for i in range(4)]


def _fair_cv_sql(folds: int, repeats: int) -> str:
    """Best formula of each training part (F1, then depth, then text), its cut, and its F1 on the held-out rows."""
    tagged = f"""(SELECT *, ((row_number() OVER (PARTITION BY repeat, y ORDER BY md5('42|' || repeat || '/' || rid)) - 1) % {folds})::INTEGER AS fold
      FROM {ITEMS}, (SELECT i::INTEGER AS repeat FROM range({repeats}) r(i)))"""
    held = f"SELECT formula, repeat, h::INTEGER AS h, v, y FROM vals, range({folds}) t(h) WHERE fold <> h"
    return f"""
WITH vals AS MATERIALIZED ({sql_values(_SMALL_TRACES, source=tagged, extra=", repeat, fold")}),
scored AS ({sql_scores(held, "formula, repeat, h")}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repeat, h ORDER BY f1 DESC, CASE WHEN formula LIKE '%(%' THEN 2 ELSE 1 END, formula) AS place FROM scored),
best AS (SELECT repeat, h AS fold, formula, direction, threshold, f1 AS train_f1 FROM ranked WHERE place = 1),
tested AS (
  SELECT b.repeat, b.fold, sum(CASE WHEN b.direction * v.v >= b.threshold THEN y ELSE 0 END) AS tp, count(*) FILTER (WHERE b.direction * v.v >= b.threshold) AS pr, sum(y) AS pos
  FROM best b JOIN vals v ON v.formula = b.formula AND v.repeat = b.repeat AND v.fold = b.fold GROUP BY ALL)
SELECT b.*, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (pr + pos) ELSE 0.0::DOUBLE END AS test_f1 FROM best b JOIN tested USING (repeat, fold)"""


@query("l02_fair_cv_formulas", _fair_cv_sql(3, 2))
def _l02b(spark, sf):
    """Two repeats of three folds over every formula of a small operator set to depth 2."""
    return ev.fair_cv(returned_items(spark, sf), folds=3, repeats=2, depth=2, beam=100, ops=_SMALL)


_REPLAY = unary("sqrt", binary(binary(leaf(0), "*", 2), "+", 3))


@query("l03_replay", f"SELECT y, count(DISTINCT sqrt(abs(qty * disc + tax))) AS n_distinct, min(sqrt(abs(qty * disc + tax))) AS low, max(sqrt(abs(qty * disc + tax))) AS high FROM {ITEMS} GROUP BY y")
def _l03(spark, sf):
    lab = returned_items(spark, sf)
    return replay(lab.df, lab.features, _REPLAY).groupBy("y").agg(F.count_distinct("value").alias("n_distinct"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("l04_baselines")
def _l04(spark, sf):
    return ev.baselines(returned_items(spark, sf), folds=2)


@query("e32_ensemble_gap")
def _e32b(spark, sf):
    """Best formula of each phase against boosted trees on held-out folds."""
    lab = returned_items(spark, sf)
    return ev.complexity_gap(se.phased_search(lab).convergence, ev.baselines(lab, folds=2, models=["GB"]))


@query("l05_compare")
def _l05(spark, sf):
    lab = returned_items(spark, sf)
    cv = ev.fair_cv(lab, folds=3, depth=1, beam=5)
    return ev.compare(cv, ev.baselines(lab, folds=3, models=["LR", "RF"]))


@query("l06_tree_rules")
def _l06(spark, sf):
    model, text = ev.tree_rules(returned_items(spark, sf), 4, 50)
    return spark.createDataFrame([(model.numNodes, model.depth, text)], "nodes int, depth int, rules string")


@query("l07_feature_importance")
def _l07(spark, sf):
    lab = returned_items(spark, sf)
    model, _ = ev.tree_rules(lab, 4, 50)
    lr = ev.classifier("LR").fit(ev.assembled(lab))
    a = ev.feature_importance(spark, model, lab.features).withColumn("model", F.lit("tree"))
    return a.unionByName(ev.feature_importance(spark, lr, lab.features).withColumn("model", F.lit("LR")))


@query("l08_per_scenario_models")
def _l08(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    lab = load_labelled(d, {"chars": F.col("n_chars"), "words": F.size(F.split("text", " "))}, F.col("toxic") == 1, F.col("doc_id").cast("string"), [F.col("lang")])
    return ev.per_scenario_models(lab, "lang")


@query("l09_cv_score")
def _l09(spark, sf):
    b = ev.baselines(returned_items(spark, sf), folds=3, models=["LR", "RF"])
    return b.groupBy("model").agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"))


_VOTE = [binary(leaf(0), "+", 1), leaf(2), binary(leaf(0), "*", 3)]


@query("l11_ensemble_vote", f"SELECT y, vote, count(*) AS n FROM (SELECT y, CASE WHEN (CASE WHEN qty + price >= 50000 THEN 1 ELSE 0 END) + (CASE WHEN -1 * disc >= -0.05::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN qty * tax >= 1 THEN 1 ELSE 0 END) > 1.5 THEN 1 ELSE 0 END AS vote FROM {ITEMS}) GROUP BY ALL")
def _l11(spark, sf):
    v = ev.ensemble_vote(returned_items(spark, sf), list(zip(_VOTE, (1, -1, 1), (50000.0, -0.05, 1.0))))
    return v.groupBy("y", "vote").agg(F.count(F.lit(1)).alias("n"))


@query("l12_holdout_split", f"SELECT (('0x' || substr(md5('42|' || rid), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) < 0.2::DOUBLE AS held, count(*) AS n, (sum(y))::BIGINT AS positives FROM {_ORD} GROUP BY 1")
def _l12(spark, sf):
    return holdout(urgent(spark, sf).df, 0.2).groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


# --- projections --------------------------------------------------------------


def _shape(df, names, digits=4):
    """Mean and spread of each derived column, and its correlation with the label."""
    agg = df.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s"), F.corr(n, "y").alias("r")).alias(n) for n in names])
    return agg.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(n)["m"], digits).alias("mean"), F.round(F.col(n)["s"], digits).alias("std"), F.round(F.coalesce(F.col(n)["r"], F.lit(0.0)), digits).alias("r")) for n in names])).alias("c")
    ).select("c.*")


def _projection_query(name, make):
    @query(name)
    def run(spark, sf):
        lab = embedded_items(spark, sf)
        model = make(lab).fit(lab.df)
        return _shape(model.transform(lab.df), model.names)


_projection_query("k01_pca", lambda lab: pj.PCA(lab.features, 6))
_projection_query("k01_pca_variance", lambda lab: pj.PCA(lab.features, share=0.5))
_projection_query("k02_pls", lambda lab: pj.PLS(lab.features, 4))
_projection_query("k03_interaction_svd", lambda lab: pj.InteractionSVD(lab.features, 4))
_projection_query("k06_nystrom_kpca", lambda lab: pj.NystromKPCA(lab.features, 4))
_projection_query("k07_neural_projection", lambda lab: pj.NeuralProjection(lab.features, 4))
_projection_query("k08_sparse_pca", lambda lab: pj.SparsePCA(lab.features, 4))


@query("k04_top_pair_products", f"SELECT formula, f1 FROM ({sql_scores(sql_values([binary(leaf(i), '*', j) for i in range(4) for j in range(i + 1, 4)]))}) ORDER BY f1 DESC, formula LIMIT 4")
def _k04(spark, sf):
    got = pj.top_pair_products(returned_items(spark, sf), 4)
    return spark.createDataFrame([(t, float(f)) for t, f, _ in got], "formula string, f1 double")


def _rff_sql() -> str:
    import numpy as np

    rng = np.random.default_rng(42)
    w = rng.normal(0.0, np.sqrt(2.0 * 0.5), (2, 3))
    b = rng.uniform(0.0, 2.0 * np.pi, 3)
    cols = [f"sqrt(2.0 / 3) * cos({float(b[k])!r}::DOUBLE + qty * {float(w[0, k])!r}::DOUBLE + disc * {float(w[1, k])!r}::DOUBLE)" for k in range(3)]
    return " UNION ALL ".join(f"SELECT 'rff{k}' AS name, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(corr({c}, y), 4) AS r FROM {ITEMS}" for k, c in enumerate(cols))


@query("k05_random_fourier", _rff_sql())
def _k05(spark, sf):
    lab = returned_items(spark, sf)
    model = pj.RandomFourier(("qty", "disc"), 3).fit(lab.df)
    return _shape(model.transform(lab.df), model.names)


@query("k09_projection_protocol")
def _k09(spark, sf):
    """Two projections fitted one after the other, saved, loaded, and scores of raw and derived columns."""
    raw = returned_items(spark, sf)
    _, models = pj.augment(raw, ["pca", "pls"], 2)
    where = f"{checkpoint_dir(spark)}/projections-{uuid.uuid4().hex}"
    pj.Chain(models).save(where)
    again = pj.Chain.load(where)
    lab = replace(raw, df=again.transform(raw.df), features=(*raw.features, *again.names))
    return score(lab, [leaf(i) for i in range(len(lab.features))]).select("formula", F.round("f1", 6).alias("f1"))

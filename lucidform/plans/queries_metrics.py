"""Scores, sweeps, group summaries, information measures and orderings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lucidform.functions import spectrum as sp
from lucidform.functions.formulas import CHECK_TRANSFORMS
from lucidform.functions.traces import binary, leaf, text
from lucidform.operators import information as info
from lucidform.operators import metrics as mt
from lucidform.operators.moments import cross_moments
from lucidform.operators.ranking import tie_prefix
from lucidform.operators.scoring import count_values, cut_table, percentile_f1, predict, score, scores_from_prefix, with_formula
from lucidform.operators.screening import percentile_scores, search_scores
from lucidform.plans.queries_candidates import ORDER_SQL, RULE_SQL, SINGLES, _pair_traces, order_features, rules
from lucidform.plans.registry import query
from lucidform.plans.sqltext import ENTROPY_SQL, ITEMS, NAMES, binned_sql, sql_cuts, sql_formula, sql_percentile_f1, sql_scores, sql_values
from lucidform.sources.labelled import returned_items, table, working_copy

_SET = [*SINGLES, binary(leaf(0), "+", 1), binary(leaf(2), "*", 3), binary(leaf(0), "/", 2), binary(leaf(1), "min", 0)]


@query("e01_exact_f1", f"SELECT formula, f1, positives, \"rows\" FROM ({sql_scores(sql_values(_SET))})")
def _e01(spark, sf):
    return score(returned_items(spark, sf), _SET).select("formula", "f1", "positives", "rows")


@query("e01_exact_f1_by_group", f"SELECT l_returnflag IS NOT NULL AS known, l_linestatus, formula, f1, auroc FROM (SELECT *, l_linestatus AS l_returnflag FROM ({sql_scores(sql_values(SINGLES, extra=', l_linestatus'), 'l_linestatus, formula')}))")
def _e01g(spark, sf):
    from lucidform.sources.labelled import load_labelled

    lab = load_labelled(
        table(spark, sf, "lineitem"), {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice"), "disc": F.col("l_discount"), "tax": F.col("l_tax")},
        F.col("l_returnflag") == "R", extra=[F.col("l_linestatus")],
    )
    return score(lab, SINGLES, by=["l_linestatus"]).select(F.lit(True).alias("known"), "l_linestatus", "formula", "f1", "auroc")


_SCREEN = SINGLES + [t for op in ("+", "-", "*", "max", "hypot") for t in _pair_traces(op)]


@query("e02_screen_f1", f"SELECT formula, f1 FROM ({sql_scores(sql_values(_SCREEN))}) ORDER BY f1 DESC, formula LIMIT 10")
def _e02(spark, sf):
    """The best ten of many candidates through shared bins; exact all the same."""
    with working_copy(returned_items(spark, sf)) as lab:
        got = search_scores(lab, _SCREEN, keep=10)
    rows = sorted(((text(s.trace, lab.features), float(s.f1)) for s in got), key=lambda r: (-r[1], r[0]))[:10]
    return spark.createDataFrame(rows, "formula string, f1 double")


@query("e03_percentile_f1", sql_percentile_f1(sql_values(_SET), (20, 30, 40, 50, 60, 70, 75, 80, 85, 90, 95)))
def _e03(spark, sf):
    return percentile_f1(returned_items(spark, sf), _SET)


@query("e03_percentile_f1_binned", sql_percentile_f1(sql_values(_SCREEN), (20, 30, 40, 50, 60, 70, 75, 80, 85, 90, 95)))
def _e03b(spark, sf):
    with working_copy(returned_items(spark, sf)) as lab:
        rows = with_formula(percentile_scores(lab, _SCREEN), lab, _SCREEN).collect()  # one row per candidate
    return spark.createDataFrame([(r["formula"], r["f1"], r["threshold"], r["direction"]) for r in rows], "formula string, f1 double, threshold double, direction string")


@query("e04_auroc", f"SELECT formula, auroc FROM ({sql_scores(sql_values(_SET))})")
def _e04(spark, sf):
    return score(returned_items(spark, sf), _SET).select("formula", "auroc")


@query("e05_best_threshold", f"SELECT formula, direction, threshold, f1 FROM ({sql_scores(sql_values(_SET))})")
def _e05(spark, sf):
    return score(returned_items(spark, sf), _SET).select("formula", "direction", "threshold", "f1")


@query("e06_apply_threshold", f"SELECT l_returnflag AS flag, (sum(CASE WHEN -1 * (qty * disc) >= -2.0::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS hits FROM {ITEMS} GROUP BY 1")
def _e06(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(predict(F.col("l_quantity") * F.col("l_discount"), -1, -2.0)).alias("hits"))


_CONF = """SELECT {k} tp, predicted - tp AS fp, pos - tp AS fn, tot - pos - predicted + tp AS tn, predicted,
 CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0::DOUBLE END AS "precision", CASE WHEN pos > 0 THEN tp / pos ELSE 0.0::DOUBLE END AS recall,
 CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (predicted + pos) ELSE 0.0::DOUBLE END AS f1, (tot - pos - predicted + tp + tp) / tot AS accuracy FROM ({src})"""


def _rule_src(by: str = "") -> str:
    k = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{n}' AS rule, (sum(CASE WHEN {e} THEN y ELSE 0 END))::BIGINT AS tp, (sum(CASE WHEN {e} THEN 1 ELSE 0 END))::BIGINT AS predicted, (sum(y))::BIGINT AS pos, count(*) AS tot FROM o {'GROUP BY ' + by if by else ''}"
        for n, e in RULE_SQL.items()
    )


@query("e07_confusion_metrics", f"WITH o AS MATERIALIZED (SELECT * FROM {ORDER_SQL}) " + _CONF.format(k="rule,", src=_rule_src()))
def _e07(spark, sf):
    return mt.confusion(order_features(spark, sf), rules(spark))


@query("l10_rule_leaderboard", f"WITH o AS MATERIALIZED (SELECT * FROM {ORDER_SQL}), r AS ({_CONF.format(k='scenario, rule,', src=_rule_src('scenario'))}) SELECT scenario, rule, f1 FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY f1 DESC, rule) AS rk FROM r) WHERE rk <= 3")
def _l10(spark, sf):
    c = mt.confusion(order_features(spark, sf), rules(spark), by=["scenario"])
    w = Window.partitionBy("scenario").orderBy(F.desc("f1"), "rule")  # one row per rule
    return c.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 3).select("scenario", "rule", "f1")


_CUTS = (0.01, 0.03, 0.05, 0.06, 0.07, 0.08)


@query(
    "e08_threshold_grid_sweep",
    f"WITH o AS MATERIALIZED (SELECT * FROM {ORDER_SQL}) " + _CONF.format(k="cut,", src=f"SELECT cut, (sum(CASE WHEN disc > cut THEN y ELSE 0 END))::BIGINT AS tp, (sum(CASE WHEN disc > cut THEN 1 ELSE 0 END))::BIGINT AS predicted, (sum(y))::BIGINT AS pos, count(*) AS tot FROM o, (VALUES {', '.join(f'({c}::DOUBLE)' for c in _CUTS)}) c(cut) GROUP BY cut"),
)
def _e08(spark, sf):
    return mt.threshold_sweep(order_features(spark, sf), "disc", _CUTS)


@query(
    "e08_rank_sweep",
    f"WITH o AS MATERIALIZED (SELECT * FROM {ORDER_SQL}) " + _CONF.format(k="cut,", src="SELECT cut, (sum(CASE WHEN lines <= cut THEN y ELSE 0 END))::BIGINT AS tp, (sum(CASE WHEN lines <= cut THEN 1 ELSE 0 END))::BIGINT AS predicted, (sum(y))::BIGINT AS pos, count(*) AS tot FROM o, (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) c(cut) GROUP BY cut"),
)
def _e08r(spark, sf):
    return mt.threshold_sweep(order_features(spark, sf), "lines", [1, 2, 3, 5], sign="<=")


_POS = "SELECT 'ratio' AS formula, ratio AS v, y FROM o WHERE ratio > 1 AND NOT isinf(ratio)"


@query(
    "e09_positive_percentile_sweep",
    f"SELECT q AS percentile, t AS threshold, tp, predicted, f1 FROM ({sql_cuts(_POS.replace('FROM o', 'FROM ' + ORDER_SQL), '(50::DOUBLE), (60::DOUBLE), (70::DOUBLE), (80::DOUBLE), (90::DOUBLE), (95::DOUBLE)', both=False)})",
)
def _e09(spark, sf):
    d = order_features(spark, sf).where((F.col("ratio") > 1) & (F.col("ratio") != float("inf"))).select("y", F.col("ratio").alias("v"))
    prefix = tie_prefix(count_values(d, []), [])
    return cut_table(prefix, [], [50, 60, 70, 80, 90, 95], both=False).select("percentile", "threshold", "tp", "predicted", "f1")


@query("e10_fine_percentile_sweep", sql_percentile_f1(sql_values(SINGLES[:2] + _SET[5:6]), range(10, 96)))
def _e10(spark, sf):
    return percentile_f1(returned_items(spark, sf), SINGLES[:2] + _SET[5:6], range(10, 96))


@query("e11_prevalence", "SELECT lang, count(*) AS n, avg(toxic) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _e11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("rate"))


_TARGET = "(SELECT l_extendedprice / 1000.0::DOUBLE AS t, l_quantity AS q, l_quantity * (1 - l_discount) AS qd, l_discount AS d FROM lineitem)"


def _target(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_extendedprice") / 1000.0).alias("t"), F.col("l_quantity").alias("q"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("qd"), F.col("l_discount").alias("d"))


@query("e12_r2_raw", " UNION ALL ".join(f"SELECT '{n}' AS name, round(1 - sum((t - {n}) * (t - {n})) / (sum((t - m) * (t - m)) + 1e-30), 6) AS r2 FROM (SELECT *, avg(t) OVER () AS m FROM {_TARGET})" for n in ("q", "qd")))
def _e12(spark, sf):
    return mt.r2_raw(_target(spark, sf), {"q": F.col("q"), "qd": F.col("qd")}, "t").withColumn("r2", F.round("r2", 6))


@query("e13_linear_fit_r2", " UNION ALL ".join(f"SELECT '{n}' AS name, round(regr_slope(t, {n}), 5) AS slope, round(regr_intercept(t, {n}), 5) AS intercept, round(regr_r2(t, {n}), 8) AS r2 FROM {_TARGET}" for n in ("q", "qd", "d")))
def _e13(spark, sf):
    f = mt.linear_fits(_target(spark, sf), {n: F.col(n) for n in ("q", "qd", "d")}, "t")
    return f.select("name", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("e14_corr_with_label", f"SELECT name, round(r, 6) AS r FROM (UNPIVOT (SELECT corr(qty, y) AS qty, corr(price, y) AS price, corr(disc, y) AS disc, corr(tax, y) AS tax FROM {ITEMS}) ON qty, price, disc, tax INTO NAME name VALUE r)")
def _e14(spark, sf):
    lab = returned_items(spark, sf)
    return mt.correlations(lab.df, lab.features, "y").withColumn("r", F.round("r", 6))


_C15 = [binary(leaf(0), "*", 1), binary(leaf(0), "+", 2), binary(leaf(3), "-", 2)]


@query(
    "e15_max_abs_corr_to_beam",
    " UNION ALL ".join(f"SELECT '{text(t, NAMES)}' AS formula, round(greatest(abs(corr({sql_formula(t)}, qty)), abs(corr({sql_formula(t)}, disc))), 6) AS diversity FROM {ITEMS}" for t in _C15),
)
def _e15(spark, sf):
    from lucidform.functions.formulas import OpSet

    lab = returned_items(spark, sf)
    got = cross_moments(lab, _C15, [leaf(0), leaf(2)], OpSet())
    return spark.createDataFrame([(text(t, lab.features), round(v, 6)) for t, v in got.items()], "formula string, diversity double")


@query(
    "e16_mutual_info",
    f"WITH o AS MATERIALIZED (SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem) SELECT round(ha, 6) AS ha, round(hb, 6) AS hb, round(hab, 6) AS hab, round(greatest(ha + hb - hab, 0), 6) AS mi FROM (SELECT {ENTROPY_SQL.format(k='a')} AS ha, {ENTROPY_SQL.format(k='b')} AS hb, {ENTROPY_SQL.format(k='a, b')} AS hab)",
)
def _e16(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return mt.mutual_info(d, "a", "b").select(*[F.round(c, 6).alias(c) for c in ("ha", "hb", "hab", "mi")])


@query(
    "e17_cond_mutual_info",
    f"""WITH o AS MATERIALIZED (SELECT * FROM {binned_sql()}) SELECT feature, round(greatest(hgf - hf - hgfy + hfy, 0), 6) AS cmi FROM ("""
    + " UNION ALL ".join(f"SELECT '{g}' AS feature, {ENTROPY_SQL.format(k=g + ', qty')} AS hgf, {ENTROPY_SQL.format(k='qty')} AS hf, {ENTROPY_SQL.format(k=g + ', qty, y')} AS hgfy, {ENTROPY_SQL.format(k='qty, y')} AS hfy" for g in ("price", "disc", "tax"))
    + ")",
)
def _e17(spark, sf):
    lab = returned_items(spark, sf)
    b = mt.percentile_bins(lab.df.select("y", *lab.features), lab.features)
    c = mt.cond_mutual_info(b, "qty_bin", ["price_bin", "disc_bin", "tax_bin"])
    return c.select(F.regexp_replace("feature", "_bin$", "").alias("feature"), F.round("cmi", 6).alias("cmi"))


@query("e18_irrelevant_features", """SELECT feature FROM (SELECT feature, greatest(hgf - hf - hgfy + hfy, 0) AS cmi FROM (WITH o AS MATERIALIZED (SELECT * FROM """ + binned_sql() + ") "
    + " UNION ALL ".join(f"SELECT '{g}' AS feature, {ENTROPY_SQL.format(k=g + ', qty')} AS hgf, {ENTROPY_SQL.format(k='qty')} AS hf, {ENTROPY_SQL.format(k=g + ', qty, y')} AS hgfy, {ENTROPY_SQL.format(k='qty, y')} AS hfy" for g in ("price", "disc", "tax"))
    + ")) WHERE cmi < 0.001::DOUBLE")
def _e18(spark, sf):
    return info.irrelevant_features(returned_items(spark, sf), "qty", 0.001).select("feature")


_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
_PAIR_SQL = f"WITH o AS MATERIALIZED (SELECT * FROM {binned_sql()}) SELECT a, b, f1 FROM (" + sql_scores(
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, avg(y) OVER (PARTITION BY {a}, {b}) AS v, y FROM o" for a, b in _PAIRS), "a, b"
) + ")"


@query("e19_pair_bound", _PAIR_SQL)
def _e19(spark, sf):
    return info.pair_scores(returned_items(spark, sf))


@query("e20_prunable_pairs", f"SELECT count(*) AS pairs, (sum(CASE WHEN f1 < 0.505::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS prunable, (sum(CASE WHEN f1 < 0.505::DOUBLE THEN 1 ELSE 0 END))::BIGINT / count(*) AS rate FROM ({_PAIR_SQL})")
def _e20(spark, sf):
    return info.prunable_pairs(info.pair_scores(returned_items(spark, sf)), 0.505)


@query("e21_distribution", "SELECT l_linenumber AS line, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM lineitem GROUP BY l_linenumber")
def _e21(spark, sf):
    return mt.distribution(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("line")), ["line"])


@query(
    "e22_describe_group",
    "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY l_returnflag",
)
def _e22(spark, sf):
    d = mt.describe(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return d.select("l_returnflag", "n", "low", "high", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median")])


_INV = ("identity", "affine", "cube", "neg", "sigmoid")
_INV_SQL = {"identity": "v", "affine": "(2.0::DOUBLE * v + 3.0::DOUBLE)", "cube": "(v * v * v)", "neg": "(-v)", "sigmoid": "(1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest(v, -500.0::DOUBLE), 500.0::DOUBLE))))"}


@query(
    "e23_invariance_check",
    f"WITH s AS ({sql_scores(' UNION ALL '.join(f'''SELECT '{k}' AS t, {e} AS v, y FROM (SELECT disc - 0.05::DOUBLE AS v, y FROM {ITEMS})''' for k, e in _INV_SQL.items()), 't')}) SELECT s.t AS transform, s.f1, s.auroc, abs(s.f1 - b.f1) > 0.001::DOUBLE AS changed FROM s, s b WHERE b.t = 'identity'",
)
def _e23(spark, sf):
    d = returned_items(spark, sf).df.select("y", (F.col("disc") - 0.05).alias("v"))
    long = d.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("transform"), CHECK_TRANSFORMS[k](F.col("v")).alias("v")) for k in _INV])).alias("s")).select("y", "s.*")
    s = scores_from_prefix(tie_prefix(count_values(long, ["transform"]), ["transform"]), ["transform"]).select("transform", "f1", "auroc")
    base = s.where(F.col("transform") == "identity").select(F.col("f1").alias("_b"))
    return s.crossJoin(F.broadcast(base)).select("transform", "f1", "auroc", (F.abs(F.col("f1") - F.col("_b")) > 0.001).alias("changed"))


@query("e24_rate_by_group", "SELECT source, count(*) AS n, (sum(toxic))::BIGINT AS positives, avg(toxic) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 20")
def _e24(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return mt.rate_by_group(d, ["source"], "toxic", 20)


@query(
    "e25_mixed_bins",
    f"""SELECT bx, "by", count(*) AS n, avg(y) AS rate FROM (SELECT floor((log10(qty) + 0.25::DOUBLE) / 0.5)::INTEGER AS bx, floor((log10(price) + 0.25::DOUBLE) / 0.5)::INTEGER AS "by", y FROM {ITEMS}) GROUP BY ALL HAVING n >= 5 AND rate > 0.05 AND rate < 0.95""",
)
def _e25(spark, sf):
    lo = 10**-0.25
    d = returned_items(spark, sf).df
    return mt.mixed_bins(d, F.col("qty"), F.col("price"), "y", lo, lo * 10**6, 12)


@query(
    "e26_family_extent",
    """SELECT user_id, coalesce(max(CASE WHEN event_type <> 'error' THEN abs(value) END), 0.0::DOUBLE) AS max_ok, coalesce(min(CASE WHEN event_type = 'error' THEN abs(value) END), 500.0::DOUBLE) AS min_not_ok,
 (sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END))::BIGINT AS n_ok, count(*) AS n FROM events GROUP BY user_id""",
)
def _e26(spark, sf):
    return mt.family_extent(table(spark, sf, "events"), "user_id", F.col("value"), F.col("event_type") != "error", 500.0)


@query(
    "e27_median_split_compare",
    f"SELECT m AS median, avg(CASE WHEN price <= m THEN y END) AS rate_low, avg(CASE WHEN price > m THEN y END) AS rate_high, avg(CASE WHEN price <= m THEN y END) / (avg(CASE WHEN price > m THEN y END) + 1e-30) AS ratio FROM {ITEMS}, (SELECT quantile_cont(price, 0.5) AS m FROM {ITEMS}) GROUP BY m",
)
def _e27(spark, sf):
    return mt.median_split(returned_items(spark, sf).df, "price", "y")


@query("e28_modal_value", "SELECT l_returnflag, price AS modal, n AS times, n / tot AS stability FROM (SELECT l_returnflag, l_quantity AS price, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag) AS tot, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY l_returnflag, l_quantity) WHERE r = 1")
def _e28(spark, sf):
    from lucidform.plans.evaluation import modal

    return modal(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]).withColumnRenamed("l_quantity", "modal")


# per supplier: share of returned items against the share of open ones, as paired scores
_PAIRED = "(SELECT l_suppkey, l_linestatus AS s, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END) AS b FROM lineitem GROUP BY ALL)"


def _paired(spark, sf):
    li = table(spark, sf, "lineitem")
    share = lambda v: F.avg(F.when(F.col("l_returnflag") == v, 1.0).otherwise(0.0))
    return li.groupBy("l_suppkey", F.col("l_linestatus").alias("s")).agg(share("R").alias("a"), share("A").alias("b"))


@query(
    "e29_paired_compare",
    f"""SELECT s, n, round(mean, 8) AS mean, round(diff, 8) AS diff, round(sd, 8) AS sd, round(diff / (sd / sqrt(n)), 5) AS t, round(abs(diff / (sd / sqrt(n))), 5) AS sigma, CASE WHEN diff > 0 THEN 'ahead' ELSE 'behind' END AS dir
 FROM (SELECT s, count(*) AS n, avg(b) AS mean, avg(a - b) AS diff, stddev_samp(a - b) AS sd FROM {_PAIRED} GROUP BY s)""",
)
def _e29(spark, sf):
    c = mt.paired_compare(_paired(spark, sf), "a", "b", ["s"])
    return c.select("s", "n", *[F.round(x, 8).alias(x) for x in ("mean", "diff", "sd")], *[F.round(x, 5).alias(x) for x in ("t", "sigma")], "dir")


@query(
    "e30_ci_outcome",
    f"""SELECT s, round(diff - h, 7) AS low, round(diff + h, 7) AS high, round(diff / sqrt(sd * sd * (1.0 / n + 0.25)), 5) AS t_corrected,
 CASE WHEN abs(diff) < 0.005 OR (diff - h <= 0 AND diff + h >= 0) THEN 'tie' WHEN diff > 0 THEN 'win' ELSE 'loss' END AS outcome
 FROM (SELECT *, 1.96 * sd / sqrt(n) AS h FROM (SELECT s, count(*) AS n, avg(a - b) AS diff, stddev_samp(a - b) AS sd FROM {_PAIRED} GROUP BY s))""",
)
def _e30(spark, sf):
    c = mt.ci_outcome(mt.corrected_t(mt.paired_compare(_paired(spark, sf), "a", "b", ["s"]), 5))
    return c.select("s", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), F.round("t_corrected", 5).alias("t_corrected"), "outcome")


@query("e31_train_test_gap", f"SELECT s, round(avg(a) - avg(b), 8) AS gap FROM {_PAIRED} GROUP BY s")
def _e31(spark, sf):
    return _paired(spark, sf).groupBy("s").agg(F.round(F.avg("a") - F.avg("b"), 8).alias("gap"))


_PHASES = "SELECT CASE WHEN formula LIKE '(%' THEN 2 ELSE 1 END AS phase, f1 FROM (" + sql_scores(sql_values(SINGLES + _pair_traces("*"))) + ")"


@query("e32_convergence", f"SELECT phase, max(best) OVER (ORDER BY phase ROWS UNBOUNDED PRECEDING) AS ceiling, 0.75::DOUBLE - max(best) OVER () AS gap FROM (SELECT phase, max(f1) AS best FROM ({_PHASES}) GROUP BY phase)")
def _e32(spark, sf):
    s = score(returned_items(spark, sf), SINGLES + _pair_traces("*"))
    g = s.groupBy(F.when(F.col("formula").startswith("("), 2).otherwise(1).alias("phase")).agg(F.max("f1").alias("best"))
    w = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)  # one row per phase
    return g.select("phase", F.max("best").over(w).alias("ceiling"), (F.lit(0.75) - F.max("best").over(Window.partitionBy())).alias("gap"))


@query("e33_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _e33(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e34_rank_threshold_sensitivity",
    """SELECT eps, len(list_filter(sv, lambda s: s / sv[1] > eps))::INTEGER AS rank, count(*) AS n FROM (SELECT list_reverse_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS sv FROM embeddings),
 (VALUES (1e-1), (1e-2), (1e-3), (1e-4)) e(eps) GROUP BY ALL""",
)
def _e34(spark, sf):
    eps = spark.createDataFrame([(0.1,), (0.01,), (0.001,), (0.0001,)], "eps double")
    sv = F.sort_array(F.transform("embedding", lambda x: F.abs(x.cast("double"))), asc=False)
    d = table(spark, sf, "embeddings").select(sv.alias("sv")).crossJoin(F.broadcast(eps))
    return d.groupBy("eps", sp.effective_rank(F.col("sv"), F.col("eps")).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "e35_accuracy_rollup",
    """WITH p AS (SELECT o_orderkey AS k, CASE WHEN list(l_quantity ORDER BY l_linenumber, l_quantity) = list(l_quantity ORDER BY l_quantity) THEN 'correct' ELSE 'wrong' END AS status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
 SELECT status, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM p GROUP BY status""",
)
def _e35(spark, sf):
    """Answers joined to the truth by id and compared as arrays."""
    li = table(spark, sf, "lineitem")
    got = li.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("answer"),
        F.array_sort(F.collect_list("l_quantity")).alias("truth"),
    )
    j = table(spark, sf, "orders").select("o_orderkey").join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    s = j.select(F.when(F.col("answer").eqNullSafe(F.col("truth")), "correct").otherwise("wrong").alias("status"))
    return mt.distribution(s, ["status"])


@query("e36_grouped_property_means", f"SELECT lines, round(avg(disc), 8) AS disc, round(avg(ratio), 6) AS ratio, avg(y) AS y FROM {ORDER_SQL} GROUP BY lines")
def _e36(spark, sf):
    return order_features(spark, sf).groupBy("lines").agg(F.round(F.avg("disc"), 8).alias("disc"), F.round(F.avg("ratio"), 6).alias("ratio"), F.avg("y").alias("y"))


@query(
    "e37_baseline_gate",
    f"""SELECT scenario, below, same, above, CASE WHEN below * 2 > below + same + above THEN 'pass' WHEN below > 0 THEN 'partial' ELSE 'fail' END AS verdict FROM (
 SELECT scenario, (sum(CASE WHEN lines < b THEN 1 ELSE 0 END))::BIGINT AS below, (sum(CASE WHEN lines = b THEN 1 ELSE 0 END))::BIGINT AS same, (sum(CASE WHEN lines > b THEN 1 ELSE 0 END))::BIGINT AS above
 FROM {ORDER_SQL}, (SELECT lines AS b FROM {ORDER_SQL} ORDER BY o_orderkey LIMIT 1) GROUP BY scenario)""",
)
def _e37(spark, sf):
    """Orders against the first order's number of lines."""
    d = order_features(spark, sf)
    base = d.orderBy("o_orderkey").limit(1).select(F.col("lines").alias("_b"))
    g = d.crossJoin(F.broadcast(base)).groupBy("scenario").agg(
        F.sum(F.when(F.col("lines") < F.col("_b"), 1).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("lines") == F.col("_b"), 1).otherwise(0)).alias("same"),
        F.sum(F.when(F.col("lines") > F.col("_b"), 1).otherwise(0)).alias("above"),
    )
    n = F.col("below") + F.col("same") + F.col("above")
    return g.withColumn("verdict", F.when(F.col("below") * 2 > n, "pass").when(F.col("below") > 0, "partial").otherwise("fail"))


# --- windows and orderings --------------------------------------------------


@query(
    "f01_tie_safe_prefix",
    f"""SELECT v, p, n, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS np FROM (SELECT price AS v, (sum(y))::BIGINT AS p, count(*) AS n FROM {ITEMS} GROUP BY price) WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)""",
)
def _f01(spark, sf):
    d = returned_items(spark, sf).df.select("y", F.col("price").alias("v"))
    return tie_prefix(count_values(d, []), []).select("v", "p", "n", "tp", "np")


@query("f02_average_ranks", f"SELECT v, (min(r) + max(r)) / 2.0::DOUBLE AS rank FROM (SELECT disc AS v, row_number() OVER (ORDER BY disc) AS r FROM {ITEMS}) GROUP BY v")
def _f02(spark, sf):
    d = returned_items(spark, sf).df.select("y", F.col("disc").alias("v"))
    t = tie_prefix(count_values(d, []), [])
    first = F.col("tot") - F.col("np") + 1
    return t.select("v", ((first + first + F.col("n") - 1) / 2.0).alias("rank"))


@query(
    "f04_topk_per_group",
    f"SELECT l_linestatus, formula, f1 FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY f1 DESC, formula) AS r FROM ({sql_scores(sql_values(SINGLES, extra=', l_linestatus'), 'l_linestatus, formula')})) WHERE r <= 2",
)
def _f04(spark, sf):
    from lucidform.sources.labelled import load_labelled

    lab = load_labelled(
        table(spark, sf, "lineitem"), {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice"), "disc": F.col("l_discount"), "tax": F.col("l_tax")},
        F.col("l_returnflag") == "R", extra=[F.col("l_linestatus")],
    )
    s = score(lab, SINGLES, by=["l_linestatus"])
    w = Window.partitionBy("l_linestatus").orderBy(F.desc("f1"), "formula")  # one row per candidate
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2).select("l_linestatus", "formula", "f1")


@query("f05_consecutive_gaps", "SELECT k, max(g) AS gap FROM (SELECT l_orderkey AS k, lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) - l_extendedprice AS g FROM lineitem) GROUP BY k")
def _f05(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice")  # the lines of one order
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.lead("l_extendedprice").over(w) - F.col("l_extendedprice")).alias("g"))
    return d.groupBy("k").agg(F.max("g").alias("gap"))


@query("f06_running_best", "SELECT m, max(best) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS best FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, max(o_totalprice) AS best FROM orders GROUP BY 1)")
def _f06(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.max("o_totalprice").alias("best"))
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return g.select("m", F.max("best").over(w).alias("best"))


@query("f07_share_of_total", "SELECT o_orderpriority, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM orders GROUP BY o_orderpriority")
def _f07(spark, sf):
    return mt.distribution(table(spark, sf, "orders"), ["o_orderpriority"])


@query("g01_beam_topb", f"SELECT formula, f1 FROM ({sql_scores(sql_values(_pair_traces('+') + _pair_traces('*')))}) ORDER BY f1 DESC, formula LIMIT 5")
def _g01(spark, sf):
    return score(returned_items(spark, sf), _pair_traces("+") + _pair_traces("*")).select("formula", "f1").orderBy(F.desc("f1"), "formula").limit(5)


@query("g02_priority_order", f"SELECT formula, 1.0::DOUBLE + CASE WHEN f1 >= 0.5009::DOUBLE THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - f1 END AS priority FROM ({sql_scores(sql_values(_pair_traces('+')))}) ORDER BY priority, formula LIMIT 5")
def _g02(spark, sf):
    h = F.when(F.col("f1") >= 0.5009, 0.0).otherwise(F.lit(1.0) - F.col("f1"))
    return score(returned_items(spark, sf), _pair_traces("+")).select("formula", (F.lit(1.0) + h).alias("priority")).orderBy("priority", "formula").limit(5)


@query(
    "g03_score_minus_diversity",
    f"""SELECT formula, round(f1 - 0.3 * d, 6) AS adjusted FROM ({sql_scores(sql_values(_C15))}) JOIN ({" UNION ALL ".join(f"SELECT '{text(t, NAMES)}' AS formula, greatest(abs(corr({sql_formula(t)}, qty)), abs(corr({sql_formula(t)}, disc))) AS d FROM {ITEMS}" for t in _C15)}) USING (formula) ORDER BY adjusted DESC, formula LIMIT 2""",
)
def _g03(spark, sf):
    from lucidform.functions.formulas import OpSet

    lab = returned_items(spark, sf)
    div = cross_moments(lab, _C15, [leaf(0), leaf(2)], OpSet())
    d = spark.createDataFrame([(text(t, lab.features), v) for t, v in div.items()], "formula string, d double")
    s = score(lab, _C15).join(F.broadcast(d), "formula")
    return s.select("formula", F.round(F.col("f1") - 0.3 * F.col("d"), 6).alias("adjusted")).orderBy(F.desc("adjusted"), "formula").limit(2)


@query("g04_funnel_schedule", f"SELECT depth, beam, count(*) AS kept FROM (SELECT lines AS l, y FROM {ORDER_SQL}), (VALUES (2, 100), (3, 60), (4, 30), (5, 15), (6, 7), (7, 3)) f(depth, beam) WHERE l = depth GROUP BY ALL")
def _g04(spark, sf):
    from lucidform.plans.search import FUNNEL

    f = spark.createDataFrame(list(FUNNEL.items()), "depth int, beam int")
    return order_features(spark, sf).join(F.broadcast(f), F.col("lines") == F.col("depth")).groupBy("depth", "beam").agg(F.count(F.lit(1)).alias("kept"))


@query("g05_report_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _g05(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("g06_most_least_coupled", f"SELECT arg_max(pair, r) AS most, arg_min(pair, r) AS least FROM ({' UNION ALL '.join(f'''SELECT '{a}-{b}' AS pair, abs(corr({a}, {b})) AS r FROM {ITEMS}''' for a, b in _PAIRS)})")
def _g06(spark, sf):
    d = returned_items(spark, sf).df
    g = d.agg(*[F.abs(F.corr(a, b)).alias(f"{a}-{b}") for a, b in _PAIRS])
    long = g.unpivot([], g.columns, "pair", "r")
    return long.agg(F.max_by("pair", "r").alias("most"), F.min_by("pair", "r").alias("least"))


@query("h01_union_of_phases", f"SELECT 1 AS phase, formula, f1 FROM ({sql_scores(sql_values(SINGLES))}) UNION ALL SELECT 2, formula, f1 FROM ({sql_scores(sql_values(_pair_traces('min')))})")
def _h01(spark, sf):
    lab = returned_items(spark, sf)
    a = score(lab, SINGLES).select(F.lit(1).alias("phase"), "formula", "f1")
    return a.unionByName(score(lab, _pair_traces("min")).select(F.lit(2).alias("phase"), "formula", "f1"))


@query("h02_union_distinct_best", f"SELECT n, max(f1) AS f1 FROM (SELECT replace(replace(formula, '(', ''), ')', '') AS n, f1 FROM ({sql_scores(sql_values(SINGLES + _pair_traces('max')))})) GROUP BY n")
def _h02(spark, sf):
    lab = returned_items(spark, sf)
    u = score(lab, SINGLES).unionByName(score(lab, _pair_traces("max") + SINGLES[:1]))
    n = F.regexp_replace("formula", "[()]", "")
    return u.groupBy(n.alias("n")).agg(F.max("f1").alias("f1"))


@query("h03_pooled_first_wins", "SELECT segment, dataset, bal FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY dataset, bal) AS r FROM (SELECT c_mktsegment AS segment, c_nationkey AS dataset, c_acctbal AS bal FROM customer)) WHERE r = 1")
def _h03(spark, sf):
    """First data set wins per criterion: a partial minimum, no per-key sort."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("dataset"), F.col("c_acctbal").alias("bal")).alias("s"))
    return c.groupBy("segment").agg(F.min("s").alias("s")).select("segment", "s.*")

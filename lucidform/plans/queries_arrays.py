"""Array summaries over embeddings and order price lists, and grid text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.functions import nested
from lucidform.functions import spectrum as sp
from lucidform.functions.traces import TRACE_TYPE, text_column
from lucidform.plans.registry import query
from lucidform.sources.labelled import table

_SV = "(SELECT vec_id, label, list_reverse_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS sv, list_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS eigs FROM embeddings)"
_FREQ = "(SELECT l_orderkey AS k, list_reverse_sort(list(l_extendedprice)) AS f FROM lineitem GROUP BY l_orderkey)"


def _sv(spark, sf) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.sort_array(F.transform(e, lambda x: F.abs(x)), asc=False).alias("sv"), F.array_sort(e).alias("eigs")
    )


def _freqs(spark, sf) -> DataFrame:
    """Prices per order, largest first; an order holds a handful of lines."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sort_array(F.collect_list("l_extendedprice"), asc=False).alias("f")
    )


def _array_query(name, column, sql, digits=None):
    shown = sql if digits is None else f"round({sql}, {digits})"

    @query(name, f"SELECT vec_id, {shown} AS value FROM {_SV}")
    def run(spark, sf):
        c = column(F.col("sv"), F.col("eigs"))
        return _sv(spark, sf).select("vec_id", (c if digits is None else F.round(c, digits)).alias("value"))


_GAPS = "list_transform(range(1, len({a})), lambda i: {a}[i+1] - {a}[i])"
_NEG_GAPS = "list_transform(range(1, len({a})), lambda i: {a}[i] - {a}[i+1])"
_array_query("b30_effective_rank", lambda s, e: sp.effective_rank(s, 0.1).cast("int"), "len(list_filter(sv, lambda s: s / sv[1] > 0.1::DOUBLE))::INTEGER")
_array_query("b31_participation_ratio", lambda s, e: sp.participation_ratio(s), "list_sum(sv) * list_sum(sv) / list_sum(list_transform(sv, lambda s: s * s))", 6)
_array_query("b32_spectral_entropy", lambda s, e: sp.spectral_entropy(s), "-list_sum(list_transform(sv, lambda s: s / list_sum(sv) * ln(s / list_sum(sv) + 1e-30)))", 6)
_array_query("b32_spectral_entropy_normalised", lambda s, e: sp.spectral_entropy(s, True), "-list_sum(list_transform(sv, lambda s: s / list_sum(sv) * ln(s / list_sum(sv) + 1e-30))) / ln(len(sv)::DOUBLE)", 6)
_array_query("b33_spectral_gap_ratio", lambda s, e: sp.gap_ratio(s), f"list_max({_NEG_GAPS.format(a='sv')}) / (sv[1] + 1e-30)", 6)
_array_query("b34_eigen_gap", lambda s, e: sp.eigen_gap(e), f"list_max({_GAPS.format(a='eigs')})", 6)
_array_query("b38_rank_at_variance_90", lambda s, e: sp.rank_at_variance(s, 0.90), "(1 + len(list_filter(range(1, len(sv) + 1), lambda k: list_sum(list_transform(sv[1:k], lambda s: s * s)) / list_sum(list_transform(sv, lambda s: s * s)) < 0.90::DOUBLE)))::INTEGER")
_array_query("b38_rank_at_variance_95", lambda s, e: sp.rank_at_variance(s, 0.95), "(1 + len(list_filter(range(1, len(sv) + 1), lambda k: list_sum(list_transform(sv[1:k], lambda s: s * s)) / list_sum(list_transform(sv, lambda s: s * s)) < 0.95::DOUBLE)))::INTEGER")
_array_query("b38_rank_at_variance_99", lambda s, e: sp.rank_at_variance(s, 0.99), "(1 + len(list_filter(range(1, len(sv) + 1), lambda k: list_sum(list_transform(sv[1:k], lambda s: s * s)) / list_sum(list_transform(sv, lambda s: s * s)) < 0.99::DOUBLE)))::INTEGER")
_array_query("b39_compression_ratio", lambda s, e: sp.compression_ratio(F.size(s).cast("double"), F.size(s).cast("double"), sp.rank_at_variance(s, 0.95)), "len(sv)::DOUBLE * len(sv) / ((1 + len(list_filter(range(1, len(sv) + 1), lambda k: list_sum(list_transform(sv[1:k], lambda s: s * s)) / list_sum(list_transform(sv, lambda s: s * s)) < 0.95::DOUBLE))) * (len(sv)::DOUBLE + len(sv)))", 6)
_array_query("b40_condition", lambda s, e: sp.condition(s), "sv[1] / (sv[len(sv)] + 1e-30)", 4)
_array_query("b40_spread", lambda s, e: sp.spread(e), "list_max(eigs) - list_min(eigs)", 6)
_array_query("b40_min_nonzero", lambda s, e: sp.min_nonzero(e), "list_min(list_filter(sv, lambda s: s > 1e-10))", 8)
_array_query("b40_kepler_deviation", lambda s, e: sp.kepler_deviation(e), "abs(sv[1] / (sv[2] + 1e-30) - 2.0::DOUBLE)", 6)
_array_query("b40_gap_position", lambda s, e: sp.gap_position(e), f"(list_position({_GAPS.format(a='eigs')}, list_max({_GAPS.format(a='eigs')})) - 1)::INTEGER")


@query("b35_freqs_from_eigs", f"SELECT k, round(list_max(g), 6) AS top, round(list_min(g), 6) AS low, len(g)::INTEGER AS n FROM (SELECT k, list_transform(f, lambda x: sqrt(abs(x))) AS g FROM {_FREQ})")
def _b35(spark, sf):
    g = _freqs(spark, sf).select("k", sp.freqs_from_eigs(F.col("f")).alias("g"))
    return g.select("k", F.round(F.col("g")[0], 6).alias("top"), F.round(F.element_at("g", -1), 6).alias("low"), F.size("g").alias("n"))


@query("b36_freq_ratio", f"SELECT k, round(CASE WHEN len(f) >= 2 THEN f[1] / f[len(f)] ELSE 1.0::DOUBLE END, 6) AS ratio FROM {_FREQ}")
def _b36(spark, sf):
    return _freqs(spark, sf).select("k", F.round(sp.freq_ratio(F.col("f")), 6).alias("ratio"))


@query("b37_cluster_count", f"SELECT k, (1 + len(list_filter(range(1, len(f)), lambda i: f[i] / (f[i+1] + 1e-30) > 2.0::DOUBLE)))::INTEGER AS clusters FROM {_FREQ}")
def _b37(spark, sf):
    return _freqs(spark, sf).select("k", sp.cluster_count(F.col("f"), 2.0).alias("clusters"))


@query(
    "b41_diophantine_gap",
    f"""WITH f AS MATERIALIZED (SELECT k, f FROM {_FREQ}),
 pairs AS (SELECT k, f[i] / f[j] AS ratio FROM f, unnest(range(1, len(f) + 1)) AS a(i), unnest(range(1, len(f) + 1)) AS b(j) WHERE i < j),
 gaps AS (SELECT k, abs(ratio - p::DOUBLE / q) * (p + q) AS g, abs(ratio - p::DOUBLE / q) AS raw FROM pairs, range(1, 11) x(p), range(1, 11) y(q)),
 best AS (SELECT k, min(g) AS gamma FROM gaps WHERE raw > 0 GROUP BY k)
 SELECT f.k, round(coalesce(gamma, 0.0::DOUBLE), 8) AS gamma FROM f LEFT JOIN best USING (k)""",
)
def _b41(spark, sf):
    return sp.diophantine_gap(_freqs(spark, sf), "k", "f").select("k", F.round("gamma", 8).alias("gamma"))


# one grid per order: a row per line with its number and quantity
_GRID = "(SELECT l_orderkey AS k, list([l_linenumber, l_quantity::INTEGER] ORDER BY l_linenumber, l_quantity) AS g FROM lineitem GROUP BY l_orderkey)"


def _grids(spark, sf) -> DataFrame:
    row = F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("g"))


_SQL_GRID_TEXT = "array_to_string(list_transform({g}, lambda r: array_to_string(r, ' ')), chr(10))"


@query("b43_format_grid", f"SELECT k, {_SQL_GRID_TEXT.format(g='g')} AS text FROM {_GRID}")
def _b43(spark, sf):
    return _grids(spark, sf).select("k", nested.format_grid(F.col("g")).alias("text"))


@query(
    "b44_format_task_prompt",
    f"""WITH t AS (SELECT o_custkey AS c, list(g ORDER BY k) AS gs FROM {_GRID} JOIN orders ON k = o_orderkey GROUP BY o_custkey)
 SELECT c, array_to_string(list_transform(range(1, len(gs) + 1), lambda i: 'Example ' || i || ':' || chr(10) || 'Input:' || chr(10) ||
  {_SQL_GRID_TEXT.format(g='gs[i]')} || chr(10) || 'Output:' || chr(10) || {_SQL_GRID_TEXT.format(g='list_reverse(gs[i])')}), chr(10) || chr(10))
  || chr(10) || chr(10) || 'Test input:' || chr(10) || {_SQL_GRID_TEXT.format(g='gs[1]')} AS prompt FROM t""",
)
def _b44(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    g = _grids(spark, sf).join(o, F.col("k") == F.col("o_orderkey"))
    t = g.groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("s"))
    pairs = F.transform("s", lambda x: F.struct(x["g"].alias("input"), F.reverse(x["g"]).alias("output")))
    return t.select("c", nested.format_task_prompt(pairs, F.col("s")[0]["g"]).alias("prompt"))


@query(
    "b45_grids_equal",
    f"SELECT g = list_reverse(g) AS same, count(*) AS n FROM {_GRID} GROUP BY 1",
)
def _b45(spark, sf):
    return _grids(spark, sf).groupBy(nested.grids_equal(F.col("g"), F.reverse("g")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b46_label_text",
    """SELECT formula, short, count(*) AS n FROM (SELECT '(' || l_returnflag || ' + ' || l_linestatus || ')' AS formula,
 substr('(' || l_returnflag || ' + ' || l_linestatus || ')', 1, 4) AS short FROM lineitem) GROUP BY ALL""",
)
def _b46(spark, sf):
    """Trace columns rendered row by row."""
    names = ("A", "N", "R", "F", "O")
    idx = lambda c: F.array_position(F.array(*[F.lit(x) for x in names]), c).cast("int") - 1
    step = lambda kind, op, i: F.struct(F.lit(kind).alias("kind"), F.lit(op).alias("op"), i.alias("feat"))
    trace = F.array(step("leaf", "", idx(F.col("l_returnflag"))), step("binary", "+", idx(F.col("l_linestatus")))).cast(TRACE_TYPE)
    d = table(spark, sf, "lineitem").select(trace.alias("t"))
    d = d.select(text_column(F.col("t"), names).alias("formula"), text_column(F.col("t"), names, 4).alias("short"))
    return d.groupBy("formula", "short").agg(F.count(F.lit(1)).alias("n"))

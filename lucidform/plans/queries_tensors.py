"""Group matrices, sparse tensors, networks and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucidform.functions import spectrum as sp
from lucidform.operators import series, tensors
from lucidform.operators.graph import connected_components
from lucidform.operators.metrics import distribution
from lucidform.plans.registry import query
from lucidform.sources.labelled import array_features, table

# four scaled columns of line items
_COLS = ("a", "b", "c", "e")
_SCALED = "(SELECT l_returnflag AS k, l_quantity / 50.0::DOUBLE AS a, l_extendedprice / 100000.0::DOUBLE AS b, l_discount * 10.0::DOUBLE AS c, l_tax * 10.0::DOUBLE AS e, l_suppkey FROM lineitem)"
_GRAM = f"(WITH s AS (SELECT * FROM {_SCALED}) SELECT k, i, j, sum(x * y) AS v, count(*) AS n FROM (SELECT k, unnest([0,1,2,3]) AS i, unnest([a,b,c,e]) AS x, [a,b,c,e] AS r FROM s), LATERAL (SELECT unnest([0,1,2,3]) AS j, unnest(r) AS y) GROUP BY k, i, j)"


def _scaled(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("k"), (F.col("l_quantity") / 50.0).alias("a"), (F.col("l_extendedprice") / 100000.0).alias("b"),
        (F.col("l_discount") * 10.0).alias("c"), (F.col("l_tax") * 10.0).alias("e"), "l_suppkey",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
    )


def _gram(spark, sf):
    return tensors.group_gram(_scaled(spark, sf), ["k"], _COLS)


# events as a sparse tensor: user bucket x type x hour
_COO = "(SELECT user_id % 8 AS u, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS t, hour(ts) AS h, value / 100.0::DOUBLE AS v FROM events)"


def _coo(spark, sf):
    t = F.col("event_type")
    code = F.when(t == "click", 0).when(t == "view", 1).when(t == "error", 2).when(t == "purchase", 3).otherwise(4)
    return table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(8)).cast("int").alias("u"), code.alias("t"), F.hour("ts").alias("h"), (F.col("value") / 100.0).alias("v")
    )


@query("m01_group_gram", f"SELECT k, i, j, round(v, 4) AS v, n FROM {_GRAM}")
def _m01(spark, sf):
    return _gram(spark, sf).withColumn("v", F.round("v", 4))


@query("m01_group_gram_wide", """SELECT label::VARCHAR AS k, i::INTEGER AS i, j::INTEGER AS j, round(sum(embedding[i+1]::DOUBLE * embedding[j+1]::DOUBLE), 5) AS v, count(*) AS n
 FROM embeddings, range(64) x(i), range(64) y(j) GROUP BY ALL""")
def _m01w(spark, sf):
    d, names = array_features(table(spark, sf, "embeddings"), "embedding", 64)
    return tensors.group_gram_wide(d, "label", names).withColumn("v", F.round("v", 5))


@query("m02_group_spectrum")
def _m02(spark, sf):
    d, names = array_features(table(spark, sf, "embeddings"), "embedding", 64)
    s = tensors.spectrum(tensors.group_gram_wide(d, "label", names), ["k"])
    sv = F.col("sv")
    return s.select(
        "k", "failed", F.when(F.col("failed"), -1).otherwise(sp.effective_rank(sv, 1e-6)).alias("rank"),
        F.round(sp.participation_ratio(sv), 4).alias("pr"), F.round(sp.spectral_entropy(sv), 4).alias("entropy"),
        F.round(sp.gap_ratio(sv), 4).alias("gap"), sp.rank_at_variance(sv, 0.95).alias("r95"), F.round(sp.spread(F.col("eigs")), 4).alias("spread"),
    )


def _mode_gram_sql(m: str, rest: str) -> str:
    return f"""WITH t AS (SELECT u, t, h, sum(v) AS v FROM {_COO} GROUP BY ALL)
 SELECT a.{m}::INTEGER AS {m}_a, b.{m}::INTEGER AS {m}_b, round(sum(a.v * b.v), 4) AS v FROM t a JOIN t b USING ({rest}) GROUP BY ALL"""


@query("m03_mode_gram", _mode_gram_sql("t", "u, h"))
def _m03(spark, sf):
    return tensors.mode_gram(_coo(spark, sf), ["u", "t", "h"], ["t"]).withColumn("v", F.round("v", 4))


@query("m03_multilinear_rank")
def _m03r(spark, sf):
    out = None
    for m in ("u", "t", "h"):
        g = tensors.mode_gram(_coo(spark, sf), ["u", "t", "h"], [m]).select(F.lit(m).alias("mode"), F.col(f"{m}_a").alias("i"), F.col(f"{m}_b").alias("j"), "v")
        out = g if out is None else out.unionByName(g)
    # singular values of the unfolding are square roots of those of its Gram matrix
    s = tensors.spectrum(out, ["mode"])
    return s.select("mode", sp.effective_rank(F.transform("sv", lambda x: F.sqrt(x)), 1e-6).alias("rank"), F.size("sv").alias("size"))


@query(
    "m04_block_norms",
    f"""SELECT k, bi, bj, round(norm, 4) AS norm, round(norm / max(m) OVER (PARTITION BY k), 6) AS rel FROM (
 SELECT k, (i // 2)::INTEGER AS bi, (j // 2)::INTEGER AS bj, sqrt(sum(v * v)) AS norm, max(abs(v)) AS m FROM {_GRAM} GROUP BY ALL)""",
)
def _m04(spark, sf):
    n = tensors.block_norms(_gram(spark, sf), ["k"], F.floor(F.col("i") / 2).cast("int"), F.floor(F.col("j") / 2).cast("int"))
    return n.select("k", "bi", "bj", F.round("norm", 4).alias("norm"), F.round("rel", 6).alias("rel"))


@query("m04_block_structure", f"""SELECT k, round(max(CASE WHEN bi <> bj THEN rel ELSE 0 END), 6) AS cross, max(CASE WHEN bi <> bj THEN rel ELSE 0 END) < 1e-6 AS is_block_diagonal FROM (
 SELECT k, bi, bj, norm / max(m) OVER (PARTITION BY k) AS rel FROM (SELECT k, i // 2 AS bi, j // 2 AS bj, sqrt(sum(v * v)) AS norm, max(abs(v)) AS m FROM {_GRAM} GROUP BY ALL)) GROUP BY k""".replace(" cross,", ' "cross",'))
def _m04b(spark, sf):
    n = tensors.block_norms(_gram(spark, sf), ["k"], F.floor(F.col("i") / 2).cast("int"), F.floor(F.col("j") / 2).cast("int"))
    s = tensors.block_structure(n, ["k"])
    return s.withColumn("cross", F.round("cross", 6))


def _bodies(g):
    """Columns 0 and 1 are of one kind, 2 and 3 of another; even ones of one body, odd ones of another."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    return tensors.body_structure(g, ["k"], (half("i"), half("j")), (F.pmod("i", F.lit(2)), F.pmod("j", F.lit(2))))


@query("m04_separable", f"""SELECT k, round(c / s, 6) AS "cross", round(q / s, 6) AS coupling, c / s < 1e-6 AS is_block_diagonal, c / s < 1e-6 AND q / s < 1e-6 AS is_separable FROM (
 SELECT k, max(m) AS s, max(CASE WHEN k1 = k2 AND b1 <> b2 THEN f ELSE 0 END) AS c, max(CASE WHEN k1 <> k2 THEN f ELSE 0 END) AS q FROM (
  SELECT k, i // 2 AS k1, j // 2 AS k2, i % 2 AS b1, j % 2 AS b2, sqrt(sum(v * v)) AS f, max(abs(v)) AS m FROM {_GRAM} GROUP BY ALL) GROUP BY k)""")
def _m04c(spark, sf):
    s = _bodies(_gram(spark, sf))
    return s.select("k", F.round("cross", 6).alias("cross"), F.round("coupling", 6).alias("coupling"), "is_block_diagonal", "is_separable")


@query("b42_complexity_score")
def _b42(spark, sf):
    g = _gram(spark, sf)
    st = _bodies(g)
    s = tensors.spectrum(g, ["k"]).join(st, "k")
    sv = F.col("sv")
    score = sp.complexity_score(sp.participation_ratio(sv), 4, F.col("cross"), sp.spectral_entropy(sv, True), F.col("is_block_diagonal"), F.col("is_separable"))
    return s.select("k", F.round(score, 4).alias("score"))


@query("m05_mode_pair_coupling")
def _m05(spark, sf):
    modes, size = ["u", "t", "h"], {"u": 8, "t": 5, "h": 24}
    out = None
    for a, b in (("u", "t"), ("u", "h"), ("t", "h")):
        rest = next(m for m in modes if m not in (a, b))
        g = tensors.mode_gram(_coo(spark, sf), modes, [a, b])
        g = g.select(
            F.lit(f"{a}-{b}").alias("pair"), (F.col(f"{a}_a") * size[b] + F.col(f"{b}_a")).alias("i"), (F.col(f"{a}_b") * size[b] + F.col(f"{b}_b")).alias("j"), "v",
            F.lit(min(size[a] * size[b], size[rest])).alias("max_rank"),
        )
        out = g if out is None else out.unionByName(g)
    top = out.groupBy("pair").agg(F.max("max_rank").alias("max_rank"))
    s = tensors.spectrum(out, ["pair"]).join(top, "pair")
    total = F.aggregate("sv", F.lit(0.0), lambda acc, x: acc + x)
    return s.select(
        "pair", F.round(F.col("sv")[0] / total, 6).alias("concentration"),
        sp.effective_rank(F.transform("sv", lambda x: F.sqrt(x)), 1e-6).alias("eff_rank"), "max_rank",
    )


def _hosvd(spark, sf):
    coo = _coo(spark, sf)
    f = tensors.hosvd_factors(coo, ["u", "t", "h"], [8, 5, 24])
    return coo, f, tensors.hosvd_core(coo, ["u", "t", "h"], f)


@query("m06_hosvd")
def _m06(spark, sf):
    """Ranks per mode and the relative error of the truncated core."""
    coo, f, core = _hosvd(spark, sf)
    whole = coo.groupBy("u", "t", "h").agg(F.sum("v").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("full"))
    kept = core.agg(F.sum(F.col("v") * F.col("v")).alias("kept"))
    return whole.crossJoin(kept).select(
        *[F.lit(f[m][1]).alias(f"rank_{m}") for m in ("u", "t", "h")],
        F.round(F.sqrt(F.greatest(F.lit(1.0) - F.col("kept") / F.col("full"), F.lit(0.0))), 4).alias("error"),
    )


@query("m07_core_sparsity")
def _m07(spark, sf):
    return tensors.core_sparsity(_hosvd(spark, sf)[2])


@query(
    "m08_exchange_symmetry",
    """WITH t AS (SELECT s_nationkey % 5 AS a, c_nationkey % 5 AS b, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
 SELECT round(1 - sqrt(sum((coalesce(x.v, 0) - coalesce(y.v, 0)) * (coalesce(x.v, 0) - coalesce(y.v, 0)))) / (2 * sqrt(sum(coalesce(x.v, 0) * coalesce(x.v, 0)))), 6) AS symmetry
 FROM t x FULL JOIN t y ON x.a = y.b AND x.b = y.a""",
)
def _m08(spark, sf):
    return tensors.exchange_symmetry(_trade(spark, sf), {"a": "b"}).withColumn("symmetry", F.round("symmetry", 6))


def _trade(spark, sf):
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.pmod("s_nationkey", F.lit(5)).alias("a"), F.pmod("c_nationkey", F.lit(5)).alias("b"), F.col("l_quantity").alias("v"))


@query(
    "m08_spatial_symmetry",
    """WITH t AS (SELECT s_nationkey % 5 AS a, c_nationkey % 5 AS b, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
 SELECT round(1 - sqrt(sum((coalesce(x.v, 0) - coalesce(y.v, 0)) * (coalesce(x.v, 0) - coalesce(y.v, 0)))) / (sqrt(sum(coalesce(x.v, 0) * coalesce(x.v, 0))) + 1e-30), 6) AS symmetry
 FROM t x FULL JOIN t y ON x.a = y.b AND x.b = y.a""",
)
def _m08c(spark, sf):
    return tensors.mode_symmetry(_trade(spark, sf), "a", "b").withColumn("symmetry", F.round("symmetry", 6))


@query("m08_decoupling", f"SELECT round(1 - sqrt(sum(CASE WHEN u < t THEN v * v ELSE 0 END)) / (sqrt(sum(v * v)) + 1e-30), 6) AS decoupling FROM {_COO}")
def _m08b(spark, sf):
    return tensors.decoupling(_coo(spark, sf), "u", "t").withColumn("decoupling", F.round("decoupling", 6))


@query(
    "m09_invariants",
    f"""WITH g AS MATERIALIZED (SELECT k, i, j, v / 1000.0::DOUBLE AS v FROM {_GRAM}), sq AS (SELECT x.k, x.i AS p, y.j AS r, sum(x.v * y.v) AS w FROM g x JOIN g y ON x.k = y.k AND x.j = y.i GROUP BY ALL)
 SELECT k, round(tr1, 4) AS tr1, round(tr2, 4) AS tr2, round(tr3, 2) AS tr3, round(fro, 4) AS frobenius FROM
 (SELECT k, sum(CASE WHEN i = j THEN v ELSE 0 END) AS tr1, sqrt(sum(v * v)) AS fro FROM g GROUP BY k) JOIN
 (SELECT k, sum(CASE WHEN p = r THEN w ELSE 0 END) AS tr2 FROM sq GROUP BY k) USING (k) JOIN
 (SELECT sq.k, sum(w * v) AS tr3 FROM sq JOIN g ON sq.k = g.k AND g.i = r AND g.j = p GROUP BY ALL) USING (k)""",
)
def _m09(spark, sf):
    g = _gram(spark, sf).withColumn("v", F.col("v") / 1000.0)
    return tensors.invariants(g, ["k"]).select("k", F.round("tr1", 4).alias("tr1"), F.round("tr2", 4).alias("tr2"), F.round("tr3", 2).alias("tr3"), F.round("frobenius", 4).alias("frobenius"))


@query("m10_index_maps", "SELECT (f // 6)::INTEGER AS a, ((f // 2) % 3)::INTEGER AS b, (f % 2)::INTEGER AS c, f::INTEGER AS flat, count(*) AS n FROM (SELECT l_partkey % 12 AS f FROM lineitem) GROUP BY ALL")
def _m10(spark, sf):
    shape = (2, 3, 2)
    d = table(spark, sf, "lineitem").select(F.pmod("l_partkey", F.lit(12)).alias("f"))
    a, b, c = tensors.unflatten_index(F.col("f"), shape)
    d = d.select(a.alias("a"), b.alias("b"), c.alias("c"))
    return d.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("flat", tensors.flatten_index([F.col("a"), F.col("b"), F.col("c")], shape))


@query("m11_spectrum_stability")
def _m11(spark, sf):
    """Bootstrap replicates of the group matrices, one job for all."""
    d = _scaled(spark, sf)
    b = tensors.bootstrap_weights(d, F.col("rid"), 8)
    w = b.withColumns({c: F.col(c) * F.sqrt(F.col("weight").cast("double")) for c in _COLS})
    base = tensors.spectrum(tensors.group_gram(d, ["k"], _COLS), ["k"]).select("k", sp.effective_rank(F.col("sv"), 1e-3).alias("r0"), F.col("sv")[0].alias("s0"))
    reps = tensors.spectrum(tensors.group_gram(w, ["k", "replicate"], _COLS), ["k", "replicate"]).join(base, "k")
    same = F.when(sp.effective_rank(F.col("sv"), 1e-3) == F.col("r0"), 1.0).otherwise(0.0)
    return reps.groupBy("k").agg(
        F.avg(same).alias("preserved"), F.sum(1.0 - same).alias("rank_changes"),
        F.round(F.avg(F.abs(F.col("sv")[0] - F.col("s0")) / F.col("s0")), 6).alias("sensitivity"),
    )


# a network between supplier and customer nations
_EDGE = """(SELECT s_nationkey AS src, c_nationkey AS dst, count(*) / 1000.0::DOUBLE AS r, sum(l_quantity) / 10000.0::DOUBLE AS x, sum(l_discount) / 100.0::DOUBLE AS b,
 s_nationkey * 25 + c_nationkey AS edge_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL)"""


def _edges(spark, sf):
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where(F.col("s_nationkey") != F.col("c_nationkey")).groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(
        (F.count(F.lit(1)) / 1000.0).alias("r"), (F.sum("l_quantity") / 10000.0).alias("x"), (F.sum("l_discount") / 100.0).alias("b")
    ).withColumn("edge_id", F.col("src") * 25 + F.col("dst"))


def _lap_sql(edges: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""WITH e AS (SELECT {k} src, dst, b, r / (r * r + x * x) AS g, -x / (r * r + x * x) AS s FROM {edges} WHERE abs(r) + abs(x) >= 1e-20)
 SELECT {k} i, j, round(sum(re), 4) AS re, round(sum(im), 4) AS im FROM (
 SELECT {k} src AS i, dst AS j, -g AS re, -s AS im FROM e UNION ALL SELECT {k} dst, src, -g, -s FROM e
 UNION ALL SELECT {k} src, src, g, s + b / 2 FROM e UNION ALL SELECT {k} dst, dst, g, s + b / 2 FROM e) GROUP BY ALL"""


@query("m12_laplacian_assembly", _lap_sql(_EDGE))
def _m12(spark, sf):
    return tensors.laplacian(_edges(spark, sf)).select("i", "j", F.round("re", 4).alias("re"), F.round("im", 4).alias("im"))


@query("m13_scenario_sweep", _lap_sql(f"(SELECT src, dst, r * scale AS r, x * scale AS x, b, scale FROM {_EDGE}, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) s(scale))", "scale"))
def _m13(spark, sf):
    e = tensors.scenario_sweep(_edges(spark, sf), [0.5, 1.0, 2.0])
    return tensors.laplacian(e, ["scale"]).select("scale", "i", "j", F.round("re", 4).alias("re"), F.round("im", 4).alias("im"))


@query("m13_leave_one_edge_out", f"SELECT d.edge_id AS dropped, count(*) AS edges, round(sum(e.x), 4) AS x FROM {_EDGE} e, {_EDGE} d WHERE d.edge_id % 4 = 0 AND e.edge_id <> d.edge_id GROUP BY ALL")
def _m13b(spark, sf):
    return tensors.leave_one_edge_out(_edges(spark, sf), ["x"]).select("dropped", "edges", F.round("x", 4).alias("x"))


@query(
    "m14_connected_components",
    """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(n, c) AS (SELECT a, a FROM links UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.n),
 comp AS (SELECT n, min(c) AS c FROM r GROUP BY n)
 SELECT c AS component, count(*) AS nodes FROM comp GROUP BY c""",
)
def _m14(spark, sf):
    """Customers and suppliers hang on nations, nations on regions."""
    def link(t, a, ca, b, cb):
        return table(spark, sf, t).select(F.concat(F.lit(a), ca).alias("src"), F.concat(F.lit(b), cb).alias("dst"))

    e = link("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(link("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    e = e.unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey"))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return connected_components(e, nodes).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@query("m15_inner_block_rank")
def _m15(spark, sf):
    """Rank of the sub-matrix over the first three columns."""
    s = tensors.spectrum(_gram(spark, sf).where((F.col("i") < 3) & (F.col("j") < 3)), ["k"])
    return s.select("k", sp.effective_rank(F.col("sv"), 1e-6).alias("rank"))


@query(
    "m16_rank_summary",
    """WITH f AS (SELECT l_orderkey AS k, list_reverse_sort(list(l_extendedprice)) AS f FROM lineitem GROUP BY l_orderkey),
 r AS (SELECT o_orderstatus AS scenario, len(list_filter(f, lambda x: x / f[1] > 0.5::DOUBLE))::INTEGER AS rank FROM f JOIN orders ON k = o_orderkey)
 SELECT scenario, rank, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY scenario) AS share, rank = min(rank) OVER (PARTITION BY scenario) AS lowest FROM r GROUP BY scenario, rank""",
)
def _m16(spark, sf):
    from pyspark.sql import Window

    f = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_extendedprice"), asc=False).alias("f"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("scenario"))
    r = f.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("scenario", sp.effective_rank(F.col("f"), 0.5).alias("rank"))
    d = distribution(r, ["rank"], within=["scenario"])
    return d.withColumn("lowest", F.col("rank") == F.min("rank").over(Window.partitionBy("scenario")))


_EV = "(SELECT user_id AS series, epoch_us(ts)::DOUBLE AS t, value AS x, (json_extract(props, '$.k'))::DOUBLE AS z FROM events)"


def _series(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("z"))


@query(
    "n01_closest_return",
    f"""WITH e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series) AS tot FROM {_EV}),
 f AS (SELECT series, x AS x0, z AS z0, tot FROM e WHERE i = 0),
 d AS (SELECT e.series, t, sqrt((x - x0) * (x - x0) + (z - z0) * (z - z0)) AS dist, sqrt(x0 * x0 + z0 * z0) AS ext, f.tot FROM e JOIN f USING (series) WHERE i > floor((e.tot - 1) * 0.1::DOUBLE)),
 m AS (SELECT series, min(dist) AS rd, arg_min(t, dist) AS rt, any_value(ext) AS ext FROM d GROUP BY series)
 SELECT series, tot AS steps, false AS collision, round(rd, 6) AS return_distance, rt AS return_time, coalesce(rd / (ext + 1e-30) < 0.05::DOUBLE, false) AS is_periodic FROM f LEFT JOIN m USING (series)""",
)
def _n01(spark, sf):
    r = series.closest_return(_series(spark, sf), "user_id", F.col("t"), ["x", "z"])
    return r.withColumn("return_distance", F.round("return_distance", 6))


@query("n02_drift", f"SELECT series, round(abs(last - first) / (abs(first) + 1e-30), 6) AS drift FROM (SELECT series, arg_min(x, t) AS first, arg_max(x, t) AS last FROM {_EV} GROUP BY series)")
def _n02(spark, sf):
    return series.drift(_series(spark, sf), "user_id", F.col("t"), "x").withColumn("drift", F.round("drift", 6))

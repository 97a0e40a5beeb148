"""Loading, encoding, files, grids and column selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lucidform.functions.formulas import sanitize
from lucidform.plans.registry import query
from lucidform.session import checkpoint_dir
from lucidform.sources import grids, results
from lucidform.sources import labelled as ld
from lucidform.sources.labelled import returned_items, table
from lucidform.plans.sqltext import ITEMS


def _folder(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a01_load_labelled", f"SELECT y, count(*) AS n, sum(qty) AS qty, min(price) AS low, max(price) AS high, count(DISTINCT rid) AS ids FROM {ITEMS} GROUP BY y")
def _a01(spark, sf):
    return returned_items(spark, sf).df.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.count_distinct("rid").alias("ids"),
    )


@query(
    "a02_split_numeric_categorical",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, '{k}' AS kind, count({c}) AS n FROM orders"
        for c, k in (("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderstatus", "categorical"), ("o_orderpriority", "categorical"))
    ),
)
def _a02(spark, sf):
    d = table(spark, sf, "orders")
    num, cat = ld.split_numeric_categorical(d)
    kind = {**{c: "numeric" for c in num}, **{c: "categorical" for c in cat}}
    agg = d.agg(*[F.count(c).alias(c) for c in kind])
    return agg.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(k).alias("kind"), F.col(c).alias("n")) for c, k in kind.items()])).alias("s")
    ).select("s.*")


@query(
    "a03_ordinal_encode",
    """WITH codes AS (SELECT c_mktsegment AS m, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING')),
 names AS (SELECT p_name AS m, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part))
 SELECT 'segment' AS col, c_mktsegment AS value, coalesce(code, -1)::DOUBLE AS code, count(*) AS n FROM customer LEFT JOIN codes ON m = c_mktsegment GROUP BY ALL
 UNION ALL SELECT 'name', p_name, code::DOUBLE, count(*) FROM part JOIN names ON m = p_name GROUP BY ALL""",
)
def _a03(spark, sf):
    c = table(spark, sf, "customer")
    fit = c.where((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "BUILDING"))
    seg = ld.ordinal_encode(c, ["c_mktsegment"], fit)
    prt = ld.ordinal_encode(table(spark, sf, "part"), ["p_name"])
    shape = lambda d, tag, col: d.groupBy(F.lit(tag).alias("col"), F.col(col).alias("value"), F.col(f"{col}_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return shape(seg, "segment", "c_mktsegment").unionByName(shape(prt, "name", "p_name"))


@query(
    "a04_binarize_label",
    """SELECT o_orderstatus AS status, CASE WHEN o_orderstatus = (SELECT max(o_orderstatus) FROM orders) THEN 1 ELSE 0 END AS last_class,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS named, count(*) AS n FROM orders GROUP BY ALL""",
)
def _a04(spark, sf):
    d = ld.binarize_label(table(spark, sf, "orders"), "o_orderstatus", out="last_class")
    d = ld.binarize_label(d, "o_orderstatus", "F", out="named")
    return d.groupBy(F.col("o_orderstatus").alias("status"), "last_class", "named").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a05_sanitize",
    """SELECT event_type, min(v) AS low, max(v) AS high, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 0.0::DOUBLE
 WHEN 'click' THEN 1e10::DOUBLE WHEN 'view' THEN -1e10::DOUBLE ELSE value END AS v FROM events) GROUP BY event_type""",
)
def _a05(spark, sf):
    t = F.col("event_type")
    broken = F.when(t == "error", F.lit(float("nan"))).when(t == "click", F.lit(float("inf"))).when(t == "view", F.lit(float("-inf"))).otherwise(F.col("value"))
    d = table(spark, sf, "events").select("event_type", broken.alias("b")).select("event_type", sanitize(F.col("b")).alias("v"))
    return d.groupBy("event_type").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))


@query(
    "a06_standardize",
    """SELECT l_returnflag, round(min(q), 6) AS q_low, round(max(q), 6) AS q_high, round(min(p), 6) AS p_low, round(max(p), 6) AS p_high, max(z) AS zero FROM (
 SELECT l_returnflag, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS q,
  (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS p, 0.0::DOUBLE AS z FROM lineitem) GROUP BY l_returnflag""",
)
def _a06(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.lit(5.0).alias("z"))
    return ld.standardize(d, ["q", "p", "z"]).groupBy("l_returnflag").agg(
        F.round(F.min("q"), 6).alias("q_low"), F.round(F.max("q"), 6).alias("q_high"),
        F.round(F.min("p"), 6).alias("p_low"), F.round(F.max("p"), 6).alias("p_high"), F.max("z").alias("zero"),
    )


@query("a07_densify", "SELECT label, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total, min(len(embedding))::INTEGER AS width FROM embeddings GROUP BY label")
def _a07(spark, sf):
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf, "embeddings").select("label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    d = ld.densify(v, "v")
    return d.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.aggregate("x", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"),
        F.min(F.size("x")).alias("width"),
    )


@query("a08_landscape_roundtrip", "SELECT l_returnflag AS scenario, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL")
def _a08(spark, sf):
    path = _folder(spark, "landscape")
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("status"), "l_quantity")
    results.write_landscape(d, path)
    return results.read_landscape(spark, path).groupBy(F.col("scenario").cast("string"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


def _documents(spark, sf):
    """One nested result document per customer."""
    m = lambda mean, dirn: F.struct(mean.alias("mean"), (F.col("a") - mean).alias("diff"), F.abs(F.col("a") - mean).alias("sigma"), dirn.alias("dir"))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("N"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    o = o.withColumn("a", F.col("lo") / F.col("hi"))
    up = F.when(F.col("a") > 0.5, F.lit("ahead")).otherwise(F.lit("behind"))
    return o.select(
        F.concat(F.lit("cust"), F.col("o_custkey")).alias("name"), "N", F.lit(4).alias("d"), F.col("a").alias("test_f1"), F.col("a").alias("train_f1"),
        F.repeat(F.concat(F.lit("f"), F.col("o_custkey")), 15).alias("formula"), F.lit(1.0).alias("stability"),
        F.struct(m(F.lit(0.5), up).alias("GB"), m(F.lit(0.25), up).alias("RF"), m(F.lit(0.0), up).alias("LR")).alias("baselines"),
    )


@query("a09_write_results", "SELECT count(*) * 2 AS documents, count(DISTINCT o_custkey) AS names FROM (SELECT DISTINCT o_custkey FROM orders)")
def _a09(spark, sf):
    path = _folder(spark, "results")
    d = _documents(spark, sf)
    results.write_results(d, path)
    results.write_results(d, path)
    return spark.read.schema(results.RESULT_SCHEMA).json(path).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("name").alias("names"))


@query(
    "a10_collect_results",
    """SELECT 'cust' || o_custkey AS name, "N", 4 AS d, a AS test_f1, a AS train_f1, substr(repeat('f' || o_custkey, 15), 1, 40) AS formula, a > 0.5 AS beats_gb,
 format('{:.1f}', abs(a - 0.5)) || CASE WHEN a > 0.5 THEN ' ahead' ELSE ' behind' END AS vs_gb, format('{:.1f}', abs(a - 0.25)) || CASE WHEN a > 0.5 THEN ' ahead' ELSE ' behind' END AS vs_rf,
 format('{:.1f}', abs(a)) || CASE WHEN a > 0.5 THEN ' ahead' ELSE ' behind' END AS vs_lr
 FROM (SELECT o_custkey, count(*) AS "N", min(o_totalprice) / max(o_totalprice) AS a FROM orders GROUP BY o_custkey)""",
)
def _a10(spark, sf):
    path = _folder(spark, "results")
    results.write_results(_documents(spark, sf), path)
    return results.collect_results(spark, path)


@query("a11_pending_jobs", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY ALL")
def _a11(spark, sf):
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job"), F.col("c_mktsegment").alias("segment"))
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("job"))
    return results.pending_jobs(jobs, done, "job").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a12_size_class",
    """SELECT name, n, CASE WHEN n > 50000 THEN 20 WHEN n > 10000 THEN 50 WHEN n > 2000 THEN 100 ELSE 200 END AS repeats,
 CASE WHEN n > 10000 THEN 50 ELSE 100 END AS beam, CASE WHEN n > 50000 THEN 5 WHEN n > 10000 THEN 8 WHEN n > 2000 THEN 10 ELSE 15 END AS subspaces,
 CASE WHEN n > 50000 THEN least(8, d + 4) WHEN n > 10000 THEN least(10, d + 4) WHEN n > 2000 THEN least(10, d + 8) ELSE least(12, d + 8) END AS subspace_k
 FROM (SELECT 'lineitem' AS name, count(*) AS n, 4 AS d FROM lineitem UNION ALL SELECT 'orders', count(*), 1 FROM orders
 UNION ALL SELECT 'customer', count(*), 1 FROM customer UNION ALL SELECT 'events', count(*), 1 FROM events)""",
)
def _a12(spark, sf):
    parts = [table(spark, sf, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(d).alias("d")) for t, d in (("lineitem", 4), ("orders", 1), ("customer", 1), ("events", 1))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.select("name", "n", *results.size_class(F.col("n"), F.col("d")))


@query(
    "a13_param_grid",
    """WITH g AS (SELECT pow(10.0::DOUBLE, -1 + a * 3.0 / 4) AS r1, pow(10.0::DOUBLE, -1 + b * 3.0 / 4) AS r2, c * 2 * pi() / 4 AS theta, e * pi() / 2 AS phi
 FROM range(5) x(a), range(5) y(b), range(4) z(c), range(3) w(e))
 SELECT round(r1, 6) AS r1, round(r2, 6) AS r2, round(theta, 6) AS theta, round(phi, 6) AS phi, count(l_quantity) AS n
 FROM g LEFT JOIN lineitem ON l_quantity <= r1 AND l_discount * 100 <= r2 GROUP BY ALL""",
)
def _a13(spark, sf):
    """Rows of the table inside every grid point's box."""
    g = grids.param_grid(spark, 5, 5, 4, 3)
    cells = table(spark, sf, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("c"))
    j = F.broadcast(g).join(cells, (F.col("l_quantity") <= F.col("r1")) & (F.col("l_discount") * 100 <= F.col("r2")))
    n = j.groupBy("r1", "r2", "theta", "phi").agg(F.sum("c").alias("n"))
    rnd = [F.round(c, 6).alias(c) for c in ("r1", "r2", "theta", "phi")]
    full = g.join(n, ["r1", "r2", "theta", "phi"], "left")
    return full.select(*rnd, F.coalesce("n", F.lit(0)).alias("n"))


def _u(seed: str, rid: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {rid}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


@query(
    "a14_random_configs",
    f"""SELECT o_orderstatus, count(*) AS n, round(min(r1), 6) AS r1_low, round(max(r2), 6) AS r2_high, round(avg(theta), 6) AS theta, round(max(phi), 6) AS phi
 FROM (SELECT o_orderstatus, pow(10.0::DOUBLE, -1 + {_u('42r1', 'o_orderkey')} * 3) AS r1, pow(10.0::DOUBLE, -1 + {_u('42r2', 'o_orderkey')} * 3) AS r2,
  {_u('42t', 'o_orderkey')} * 2 * pi() AS theta, {_u('42p', 'o_orderkey')} * pi() AS phi FROM orders) GROUP BY o_orderstatus""",
)
def _a14(spark, sf):
    d = grids.random_configs(table(spark, sf, "orders"), F.col("o_orderkey").cast("string"))
    return d.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("r1"), 6).alias("r1_low"), F.round(F.max("r2"), 6).alias("r2_high"),
        F.round(F.avg("theta"), 6).alias("theta"), F.round(F.max("phi"), 6).alias("phi"),
    )


@query(
    "a15_synthetic_tables",
    " UNION ALL ".join(
        f"""SELECT '{k}' AS kind, count(*) AS n, (sum(CASE WHEN {rule} THEN 1 ELSE 0 END))::BIGINT AS positives, round(min(x1), 6) AS low FROM (
 SELECT ({_u('7a', 'o_orderkey')} * 2.0::DOUBLE - 1.0::DOUBLE) * {h} AS x1, ({_u('7b', 'o_orderkey')} * 2.0::DOUBLE - 1.0::DOUBLE) * {h} AS x2 FROM orders)"""
        for k, h, rule in (("circles", "2.0::DOUBLE", "x1 * x1 + x2 * x2 < 1"), ("linear", "5.0::DOUBLE", "x1 + x2 > 0"), ("product", "3.0::DOUBLE", "x1 * x2 > 1"))
    ),
)
def _a15(spark, sf):
    o = table(spark, sf, "orders")
    out = None
    for k in ("circles", "linear", "product"):
        d = grids.fixture(o, F.col("o_orderkey").cast("string"), k).agg(
            F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.round(F.min("x1"), 6).alias("low")
        )
        out = d if out is None else out.unionByName(d)
    return out.select("kind", "n", "positives", "low")


@query("a15_equation_tables", f"""SELECT 'gravity' AS name, count(*) AS n, round(avg(a * b / (c * c)), 6) AS mean FROM (
 SELECT 1 + {_u('11a', 'o_orderkey')} * 4 AS a, 1 + {_u('11b', 'o_orderkey')} * 4 AS b, 1 + {_u('11c', 'o_orderkey')} * 4 AS c FROM orders)
 UNION ALL SELECT 'sum_of_squares', count(*), round(avg(a * a + b * b), 6) FROM (
 SELECT 1 + {_u('11a', 'o_orderkey')} * 4 AS a, 1 + {_u('11b', 'o_orderkey')} * 4 AS b FROM orders)""")
def _a15b(spark, sf):
    o, rid = table(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    parts = [grids.equation_table(o, rid, k).agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean")) for k in ("gravity", "sum_of_squares")]
    return parts[0].unionByName(parts[1])

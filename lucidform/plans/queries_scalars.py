"""Row-wise formula operators over line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidform.functions.formulas import BINARY, CHECK_TRANSFORMS, FEATURE_TRANSFORMS, PRESETS, UNARY, OpSet, sanitize
from lucidform.functions.traces import project_formulas, text, triple_templates
from lucidform.operators.scoring import long_values
from lucidform.plans.registry import query
from lucidform.plans.sqltext import BINARY_SQL, ITEMS, NAMES, UNARY_SQL, sql_formula
from lucidform.sources.labelled import returned_items, table


def _args() -> tuple[Column, Column]:
    return F.col("l_quantity") - 25.0, F.col("l_discount") - 0.05


_SQL_A, _SQL_B = "(l_quantity - 25.0::DOUBLE)", "(l_discount - 0.05::DOUBLE)"
_EXACT = """SELECT l_returnflag, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS low, max(v) AS high,
 (sum(CASE WHEN v > 0 THEN 1 ELSE 0 END))::BIGINT AS n_positive
 FROM (SELECT l_returnflag, coalesce({e}, 0) AS v FROM lineitem) GROUP BY l_returnflag"""
_ROUND = """SELECT l_returnflag, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean,
 (sum(CASE WHEN v > 0.25 THEN 1 ELSE 0 END))::BIGINT AS n_above
 FROM (SELECT l_returnflag, coalesce({e}, 0) AS v FROM lineitem) GROUP BY l_returnflag"""


def _exact(spark: SparkSession, sf: str, value: Column) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_returnflag", value.alias("v")).select("l_returnflag", sanitize(F.col("v")).alias("v"))
    return d.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("v").alias("n_distinct"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).alias("n_positive"),
    )


def _rounded(spark: SparkSession, sf: str, value: Column) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_returnflag", value.alias("v")).select("l_returnflag", sanitize(F.col("v")).alias("v"))
    return d.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("v"), 6).alias("low"),
        F.round(F.max("v"), 6).alias("high"),
        F.round(F.avg("v"), 6).alias("mean"),
        F.sum(F.when(F.col("v") > 0.25, 1).otherwise(0)).alias("n_above"),
    )


_NAMED = {"+": "add", "-": "sub", "*": "mul", "/": "div"}
for _i, (_name, _op) in enumerate(BINARY.items(), 1):
    query(f"b{_i:02d}_{_NAMED.get(_name, _name)}", _EXACT.format(e=BINARY_SQL[_name].format(a=_SQL_A, b=_SQL_B)))(
        lambda spark, sf, op=_op: _exact(spark, sf, op.column(*_args()))
    )
for _i, (_name, _op) in enumerate(UNARY.items(), 11):
    _soft = _name in ("log", "sigmoid", "tanh")
    query(f"b{_i:02d}_{_name}", (_ROUND if _soft else _EXACT).format(e=UNARY_SQL[_name].format(x=_SQL_A)))(
        lambda spark, sf, op=_op, soft=_soft: (_rounded if soft else _exact)(spark, sf, op.column(_args()[0]))
    )

_CHECK_SQL = {
    "identity": "x",
    "affine": "2.0::DOUBLE * x + 3.0::DOUBLE",
    "cube": "x * x * x",
    "exp": "exp(least(greatest(x, -500.0::DOUBLE), 500.0::DOUBLE))",
    "sin": "sin(x)",
    "inv_pos": "1.0::DOUBLE / (abs(x) + 1e-30)",
}


@query(
    "b19_check_transforms",
    " UNION ALL ".join(
        f"SELECT '{k}' AS transform, round(min({e}), 6) AS low, round(max({e}), 6) AS high, count(*) AS n "
        "FROM (SELECT l_discount * 10.0::DOUBLE + 0.5::DOUBLE AS x FROM lineitem)"
        for k, e in _CHECK_SQL.items()
    ),
)
def _b19(spark, sf):
    x = F.col("l_discount") * 10.0 + 0.5
    d = table(spark, sf, "lineitem").select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("transform"), CHECK_TRANSFORMS[k](x).alias("v")) for k in _CHECK_SQL])).alias("s")
    ).select("s.*")
    return d.groupBy("transform").agg(
        F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.count(F.lit(1)).alias("n")
    )


def _template_traces(which: str):
    return [b(0, 1, 2) for b in triple_templates(which).values()]


def _template_sql(which: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{text(t, NAMES)}' AS formula, min({sql_formula(t)}) AS low, max({sql_formula(t)}) AS high, "
        f"count(DISTINCT {sql_formula(t)}) AS n_distinct FROM {ITEMS}"
        for t in _template_traces(which)
    )


def _templates(spark, sf, which):
    lab = returned_items(spark, sf)
    ts = _template_traces(which)
    names = F.array(*[F.lit(text(t, lab.features)) for t in ts])
    return (
        long_values(lab, ts)
        .groupBy("cand")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("v").alias("n_distinct"))
        .select(F.get(names, F.col("cand")).alias("formula"), "low", "high", "n_distinct")
    )


query("b20_triple_templates_basic", _template_sql("basic"))(lambda spark, sf: _templates(spark, sf, "basic"))
query("b21_triple_templates_wide", _template_sql("wide"))(lambda spark, sf: _templates(spark, sf, "wide"))

_FT_SQL = {
    "log10p1": "log10(x + 1.0::DOUBLE)",
    "inv_eps": "1.0::DOUBLE / (x + 1e-10)",
    "inv_cube": "1.0::DOUBLE / (x * x * x + 1e-10)",
    "square": "x * x",
    "neg_part": "CASE WHEN z < 0 THEN -z ELSE 0.0::DOUBLE END",
    "ratio": "x / (w + 1e-10)",
    "product": "x * w",
    "sum": "x + w",
}


@query(
    "b22_feature_transforms",
    " UNION ALL ".join(
        f"SELECT '{k}' AS transform, round(min({e}), 4) AS low, round(max({e}), 4) AS high, round(avg({e}), 4) AS mean "
        "FROM (SELECT l_quantity AS x, l_quantity - 25.0::DOUBLE AS z, l_tax + 1.0::DOUBLE AS w FROM lineitem)"
        for k, e in _FT_SQL.items()
    ),
)
def _b22(spark, sf):
    x, z, w = F.col("l_quantity"), F.col("l_quantity") - 25.0, F.col("l_tax") + 1.0
    args = {k: ((x, w) if k in ("ratio", "product", "sum") else (z,) if k == "neg_part" else (x,)) for k in _FT_SQL}
    d = table(spark, sf, "lineitem").select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("transform"), FEATURE_TRANSFORMS[k](*args[k]).alias("v")) for k in _FT_SQL])
        ).alias("s")
    ).select("s.*")
    return d.groupBy("transform").agg(
        F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"), F.round(F.avg("v"), 4).alias("mean")
    )


@query(
    "b23_preset_ranges",
    " UNION ALL ".join(
        f"SELECT '{p}' AS preset, '{o}' AS op, min({(BINARY_SQL[o].format(a='qty', b='disc') if k == 0 else UNARY_SQL[o].format(x='qty'))}) AS low FROM {ITEMS}"
        for p, pair in PRESETS.items()
        for k, group in enumerate(pair)
        for o in group
        if o not in ("log", "sigmoid", "tanh")
    ),
)
def _b23(spark, sf):
    """Smallest value of every exactly comparable operator, per operator set."""
    lab = returned_items(spark, sf)
    rows, mins = [], {}
    for p in PRESETS:
        ops = OpSet.preset(p)
        for o in (*ops.binary.values(), *ops.unary.values()):
            if o.name in ("log", "sigmoid", "tanh"):
                continue
            key = f"{o.arity}{o.name}"
            mins[key] = (("leaf", "", 0), ("binary", o.name, 2) if o.arity == 2 else ("unary", o.name, -1))
            rows.append((p, o.name, key))
    keys = list(mins)
    wide = project_formulas(lab.df, lab.features, [mins[k] for k in keys])
    agg = wide.agg(*[F.min(f"v{i}").alias(f"v{i}") for i in range(len(keys))])
    return agg.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("preset"), F.lit(o).alias("op"), F.col(f"v{keys.index(k)}").alias("low"))
                    for p, o, k in rows
                ]
            )
        ).alias("s")
    ).select("s.*")



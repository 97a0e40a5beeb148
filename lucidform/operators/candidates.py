"""Candidate formulas as rows.

Schema: cand_id, parent_id, depth, trace, formula, canon, n_features, feats.
Candidate tables are generated from feature and operator tables; their size is
set by the search parameters and does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucidform.functions import traces as tr
from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import TRACE_TYPE, Trace

COLUMNS = ("cand_id", "parent_id", "depth", "trace", "formula", "canon", "n_features", "feats")


def feature_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "feat int, name string")


def op_table(spark: SparkSession, ops: OpSet) -> tuple[DataFrame, DataFrame]:
    b = spark.createDataFrame([(o.name, o.commutative) for o in ops.binary.values()], "op string, commutative boolean")
    u = spark.createDataFrame([(o.name, o.monotone) for o in ops.unary.values()], "op string, monotone boolean")
    return b, u


def _step(kind: str, op: Column, feat: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), op.alias("op"), feat.cast("int").alias("feat"))


def _row(parent: Column, depth: Column, trace: Column, formula: Column, canon: Column, feats: Column) -> list[Column]:
    used = F.array_sort(F.array_distinct(feats))
    return [
        F.xxhash64(formula).alias("cand_id"),
        parent.alias("parent_id"),
        depth.cast("int").alias("depth"),
        trace.cast(TRACE_TYPE).alias("trace"),
        formula.alias("formula"),
        canon.alias("canon"),
        F.size(used).alias("n_features"),
        used.alias("feats"),
    ]


def leaves(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """One candidate per feature."""
    f = feature_table(spark, names)
    return f.select(
        *_row(
            F.lit(None).cast("long"),
            F.lit(1),
            F.array(_step("leaf", F.lit(""), F.col("feat"))),
            F.col("name"),
            F.col("name"),
            F.array("feat"),
        )
    )


def _binary_text(left: Column, op: Column, right: Column) -> Column:
    return F.concat(F.lit("("), left, F.lit(" "), op, F.lit(" "), right, F.lit(")"))


def _canon(left: Column, op: Column, right: Column, commutative: Column) -> Column:
    return F.when(commutative, _binary_text(F.least(left, right), op, F.greatest(left, right))).otherwise(
        _binary_text(left, op, right)
    )


def pairwise(spark: SparkSession, names: Sequence[str], ops: OpSet, allow_self: bool = False) -> DataFrame:
    """All ordered feature pairs times binary operators."""
    return expand_binary(leaves(spark, names), names, ops, allow_self)


def expand_binary(
    cands: DataFrame, names: Sequence[str], ops: OpSet, allow_self: bool = True, swapped: bool = False
) -> DataFrame:
    """``f op leaf`` for every candidate, operator and leaf (``leaf op f`` if swapped)."""
    spark = cands.sparkSession
    f = feature_table(spark, names)
    b, _ = op_table(spark, ops)
    x = cands.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(b))
    if not allow_self:
        x = x.where(~((F.size("feats") == 1) & (F.size("trace") == 1) & (F.col("feats")[0] == F.col("feat"))))
    kind = "binary_r" if swapped else "binary"
    left, right = (F.col("name"), F.col("formula")) if swapped else (F.col("formula"), F.col("name"))
    cl, cr = (F.col("name"), F.col("canon")) if swapped else (F.col("canon"), F.col("name"))
    return x.select(
        *_row(
            F.col("cand_id"),
            F.col("depth") + 1,
            F.concat("trace", F.array(_step(kind, F.col("op"), F.col("feat")))),
            _binary_text(left, F.col("op"), right),
            _canon(cl, F.col("op"), cr, F.col("commutative")),
            F.concat("feats", F.array("feat")),
        )
    )


def expand_unary(cands: DataFrame, ops: OpSet, skip_monotone: bool = False) -> DataFrame:
    """``op(f)`` for every candidate and unary operator."""
    _, u = op_table(cands.sparkSession, ops)
    if skip_monotone:
        u = u.where(~F.col("monotone"))
    x = cands.crossJoin(F.broadcast(u))
    return x.select(
        *_row(
            F.col("cand_id"),
            F.col("depth") + 1,
            F.concat("trace", F.array(_step("unary", F.col("op"), F.lit(-1)))),
            F.concat(F.col("op"), F.lit("("), F.col("formula"), F.lit(")")),
            F.concat(F.col("op"), F.lit("("), F.col("canon"), F.lit(")")),
            F.col("feats"),
        )
    )


def expand(
    cands: DataFrame, names: Sequence[str], ops: OpSet, allow_self: bool = True, skip_monotone: bool = False
) -> DataFrame:
    """Children of a beam: binary with every leaf, and unary; ``parent_id`` is the lineage edge."""
    return expand_binary(cands, names, ops, allow_self).unionByName(expand_unary(cands, ops, skip_monotone))


def expand_both_orders(cands: DataFrame, names: Sequence[str], ops: OpSet, max_depth: int) -> DataFrame:
    """``f op leaf``, ``leaf op f`` and ``op(f)``, with at most 2 * depth + 1 nodes."""
    out = (
        expand_binary(cands, names, ops)
        .unionByName(expand_binary(cands, names, ops, swapped=True))
        .unionByName(expand_unary(cands, ops))
    )
    return out.where(complexity(F.col("trace")) <= 2 * max_depth + 1)


def complexity(trace: Column) -> Column:
    """Nodes of the formula tree: two per binary step, one per other step."""
    return F.aggregate(
        trace, F.lit(0), lambda acc, s: acc + F.when(s["kind"].isin("binary", "binary_r"), 2).otherwise(1)
    )


def triples(spark: SparkSession, names: Sequence[str], ids: Sequence[int], which: str = "basic") -> DataFrame:
    """Template formulas over feature triples; ``ids`` in order of preference (i<j<k by position)."""
    order = spark.createDataFrame([(p, i) for p, i in enumerate(ids)], "pos int, feat int")
    a, b, c = (order.select(F.col("pos").alias(f"p{x}"), F.col("feat").alias(x)) for x in "abc")
    t = a.join(F.broadcast(b), F.col("pa") < F.col("pb")).join(F.broadcast(c), F.col("pb") < F.col("pc"))
    slot = {0: F.col("a"), 1: F.col("b"), 2: F.col("c")}
    table = F.array(*[F.lit(n) for n in names])
    rows = []
    for build in tr.triple_templates(which).values():
        steps = build(0, 1, 2)
        trace = F.array(*[_step(k, F.lit(op), slot[i]) for k, op, i in steps])
        rows.append(F.struct(trace.cast(TRACE_TYPE).alias("trace")))
    long = t.select("a", "b", "c", F.explode(F.array(*rows)).alias("r")).select("a", "b", "c", "r.trace")
    formula = tr.text_column(F.col("trace"), names)
    return long.select(
        *_row(F.lit(None).cast("long"), F.lit(3), F.col("trace"), formula, formula, F.array("a", "b", "c"))
    )


def dedup_formula(cands: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per formula text, without those already seen."""
    out = cands.dropDuplicates(["formula"])
    return out if seen is None else out.join(seen.select("formula"), "formula", "left_anti").select(*cands.columns)


def dedup_canonical(cands: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per formula up to argument order of commutative operators: the
    alphabetically first text."""
    rest = [c for c in cands.columns if c not in ("formula", "canon")]
    out = (
        cands.groupBy("canon")
        .agg(F.min(F.struct("formula", *rest)).alias("_m"))
        .select("canon", "_m.*")
        .select(*cands.columns)
    )
    return out if seen is None else out.join(seen.select("canon"), "canon", "left_anti").select(*cands.columns)


def collect_traces(cands: DataFrame) -> list[tuple[Trace, dict]]:
    """The generated candidates on the driver, for the scoring kernels."""
    return [(tr.from_rows(r["trace"]), r.asDict()) for r in cands.orderBy("formula").collect()]


def from_traces(spark: SparkSession, traces: Sequence[Trace], names: Sequence[str], depth: int | None = None) -> DataFrame:
    """Candidate rows for traces held by the driver (a beam)."""
    rows = [
        (
            [{"kind": k, "op": o, "feat": i} for k, o, i in t],
            tr.text(t, names),
            canonical_text(t, names),
            tr.feats(t),
            depth if depth is not None else len(t),
        )
        for t in traces
    ]
    schema = T.StructType(
        [
            T.StructField("trace", T._parse_datatype_string(TRACE_TYPE)),
            T.StructField("formula", T.StringType()),
            T.StructField("canon", T.StringType()),
            T.StructField("feats", T.ArrayType(T.IntegerType())),
            T.StructField("depth", T.IntegerType()),
        ]
    )
    d = spark.createDataFrame(rows, schema)
    return d.select(
        *_row(F.lit(None).cast("long"), F.col("depth"), F.col("trace"), F.col("formula"), F.col("canon"), F.col("feats"))
    )


def canonical_text(trace: Trace, names: Sequence[str]) -> str:
    from lucidform.functions.formulas import BINARY

    out = ""
    for kind, op, i in trace:
        if kind == "leaf":
            out = names[i]
        elif kind == "unary":
            out = f"{op}({out})"
        else:
            l, r = (out, names[i]) if kind == "binary" else (names[i], out)
            if op in BINARY and BINARY[op].commutative and r < l:
                l, r = r, l
            out = f"({l} {op} {r})"
    return out

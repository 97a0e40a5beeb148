"""Formula traces: the ordered steps that build a formula from columns.

A trace is a tuple of ``(kind, op, feat)`` steps.  ``leaf`` loads a feature,
``binary`` computes ``f op leaf``, ``binary_r`` computes ``leaf op f`` and
``unary`` applies ``op`` to what is there.  The same steps travel in candidate
tables as ``array<struct<kind,op,feat>>``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet, sanitize, sanitize_array

Step = tuple[str, str, int]
Trace = tuple[Step, ...]
TRACE_TYPE = "array<struct<kind:string,op:string,feat:int>>"


def leaf(i: int) -> Trace:
    return (("leaf", "", i),)


def binary(f: Trace, op: str, i: int) -> Trace:
    return (*f, ("binary", op, i))


def binary_r(i: int, op: str, f: Trace) -> Trace:
    return (*f, ("binary_r", op, i))


def unary(op: str, f: Trace) -> Trace:
    return (*f, ("unary", op, -1))


def from_rows(steps: Iterable) -> Trace:
    return tuple((s["kind"], s["op"], int(s["feat"])) for s in steps)


def text(trace: Trace, names: Sequence[str]) -> str:
    out = ""
    for kind, op, i in trace:
        if kind == "leaf":
            out = names[i]
        elif kind == "binary":
            out = f"({out} {op} {names[i]})"
        elif kind == "binary_r":
            out = f"({names[i]} {op} {out})"
        else:
            out = f"{op}({out})"
    return out


def feats(trace: Trace) -> list[int]:
    return sorted({i for _, _, i in trace if i >= 0})


# Templates over three features a, b, c.  "basic" has 4, "wide" has 9.
def triple_templates(which: str = "basic") -> dict[str, callable]:
    basic = {
        "a*b+c": lambda a, b, c: binary(binary(leaf(a), "*", b), "+", c),
        "a+b*c": lambda a, b, c: binary_r(a, "+", binary(leaf(b), "*", c)),
        "a*b*c": lambda a, b, c: binary(binary(leaf(a), "*", b), "*", c),
        "a*b/c": lambda a, b, c: binary(binary(leaf(a), "*", b), "/", c),
    }
    if which == "basic":
        return basic
    return {
        **basic,
        "a+b+c": lambda a, b, c: binary(binary(leaf(a), "+", b), "+", c),
        "(a+b)/c": lambda a, b, c: binary(binary(leaf(a), "+", b), "/", c),
        "a/(b+c)": lambda a, b, c: binary_r(a, "/", binary(leaf(b), "+", c)),
        "(a-b)*c": lambda a, b, c: binary(binary(leaf(a), "-", b), "*", c),
        "max(a,b)*c": lambda a, b, c: binary(binary(leaf(a), "max", b), "*", c),
    }


def text_column(trace: Column, names: Sequence[str], limit: int | None = None) -> Column:
    """Render a trace column as formula text."""
    table = F.array(*[F.lit(n) for n in names])

    def step(acc: Column, s: Column) -> Column:
        name = F.get(table, s["feat"])
        return (
            F.when(s["kind"] == "leaf", name)
            .when(s["kind"] == "binary", F.concat(F.lit("("), acc, F.lit(" "), s["op"], F.lit(" "), name, F.lit(")")))
            .when(s["kind"] == "binary_r", F.concat(F.lit("("), name, F.lit(" "), s["op"], F.lit(" "), acc, F.lit(")")))
            .otherwise(F.concat(s["op"], F.lit("("), acc, F.lit(")")))
        )

    out = F.aggregate(trace, F.lit(""), step)
    return out if limit is None else F.substring(out, 1, limit)


def project_formulas(
    df: DataFrame,
    features: Sequence[str],
    traces: Sequence[Trace],
    keep: Sequence[str | Column] = (),
    ops: OpSet | None = None,
) -> DataFrame:
    """One column ``v0..`` per trace, next to ``keep``.

    Formulas are built step by step in stacked projections, so a prefix shared
    by many formulas is computed once and the sanitised value of a step is not
    repeated inside the next one.
    """
    ops = ops or OpSet()
    used = sorted({i for t in traces for i in feats(t)})
    cur = df.select(*keep, *[sanitize(F.col(features[i]).cast("double")).alias(f"_f{i}") for i in used])
    kept = cur.columns[: len(cur.columns) - len(used)]
    leaves = [f"_f{i}" for i in used]
    known: dict[Trace, str] = {}
    for level in range(1, max(len(t) for t in traces) + 1):
        raw: dict[str, Column] = {}
        for t in traces:
            pre = t[:level]
            if len(t) < level or pre in known:
                continue
            kind, op, i = pre[-1]
            if kind == "leaf":
                known[pre] = f"_f{i}"
                continue
            name = f"_n{len(known)}"
            src = F.col(known[pre[:-1]])
            if kind == "binary":
                expr = ops.op(op, 2).column(src, F.col(f"_f{i}"))
            elif kind == "binary_r":
                expr = ops.op(op, 2).column(F.col(f"_f{i}"), src)
            else:
                expr = ops.op(op, 1).column(src)
            raw[name] = expr
            known[pre] = name
        if raw:
            carried = [c for c in cur.columns]
            cur = cur.select(*carried, *[e.alias(n) for n, e in raw.items()])
            cur = cur.select(*carried, *[sanitize(F.col(n)).alias(n) for n in raw])
    return cur.select(*kept, *[F.col(known[t]).alias(f"v{k}") for k, t in enumerate(traces)])


def replay(df: DataFrame, features: Sequence[str], trace: Trace, name: str = "value", ops: OpSet | None = None) -> DataFrame:
    """``df`` plus the value of one formula; stateless, so it also runs on streams."""
    out = project_formulas(df, features, [trace], keep=[F.col(c) for c in df.columns], ops=ops)
    return out.withColumnRenamed("v0", name)


def evaluate(trace: Trace, columns: Sequence[np.ndarray], ops: OpSet) -> np.ndarray:
    """Value of a trace on one batch of sanitised feature arrays."""
    v = columns[trace[0][2]]
    for step in trace[1:]:
        v = apply_step(v, step, columns, ops)
    return v


def apply_step(v: np.ndarray, step: Step, columns: Sequence[np.ndarray], ops: OpSet) -> np.ndarray:
    kind, op, i = step
    with np.errstate(all="ignore"):
        if kind == "binary":
            out = ops.op(op, 2).array(v, columns[i])
        elif kind == "binary_r":
            out = ops.op(op, 2).array(columns[i], v)
        else:
            out = ops.op(op, 1).array(v)
    return sanitize_array(out)

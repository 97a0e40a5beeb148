"""SQL text of formulas and scores, for stating query results in plain SQL."""

from __future__ import annotations

from collections.abc import Sequence

from lucidform.functions.traces import Trace, text

BINARY_SQL = {
    "+": "({a} + {b})",
    "-": "({a} - {b})",
    "*": "({a} * {b})",
    "/": "({a} / ({b} + 1e-30))",
    "max": "greatest({a}, {b})",
    "min": "least({a}, {b})",
    "hypot": "sqrt({a} * {a} + {b} * {b})",
    "diff_sq": "(({a} - {b}) * ({a} - {b}))",
    "harmonic": "(2.0::DOUBLE * {a} * {b} / ({a} + {b} + 1e-30))",
    "geometric": "(sign({a} * {b}) * sqrt(abs({a} * {b})))",
    "mean": "(({a} + {b}) / 2.0::DOUBLE)",
}
UNARY_SQL = {
    "cube": "({x} * {x} * {x})",
    "log": "ln(abs({x}) + 1e-30)",
    "sqrt": "sqrt(abs({x}))",
    "sq": "({x} * {x})",
    "inv": "(1.0::DOUBLE / ({x} + 1e-30))",
    "neg": "(-{x})",
    "abs": "abs({x})",
    "sigmoid": "(1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest({x}, -500.0::DOUBLE), 500.0::DOUBLE))))",
    "tanh": "tanh(least(greatest({x}, -500.0::DOUBLE), 500.0::DOUBLE))",
}

ITEMS = """(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid,
 l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_returnflag, l_linestatus, l_linenumber, l_orderkey FROM lineitem)"""
NAMES = ("qty", "price", "disc", "tax")


def sql_formula(trace: Trace, names: Sequence[str] = NAMES) -> str:
    out = ""
    for kind, op, i in trace:
        if kind == "leaf":
            out = names[i]
        elif kind == "binary":
            out = BINARY_SQL[op].format(a=out, b=names[i])
        elif kind == "binary_r":
            out = BINARY_SQL[op].format(a=names[i], b=out)
        else:
            out = UNARY_SQL[op].format(x=out)
    return out


def sql_values(traces: Sequence[Trace], names: Sequence[str] = NAMES, source: str = ITEMS, extra: str = "", where: str = "") -> str:
    """(formula, v, y[, extra]) for every row and formula."""
    parts = [
        f"SELECT '{text(t, names)}' AS formula, coalesce({sql_formula(t, names)}, 0) AS v, y{extra} FROM src" for t in traces
    ]
    return f"WITH src AS MATERIALIZED (SELECT * FROM {source} {where}) " + " UNION ALL ".join(parts)


def sql_scores(values: str, keys: str = "formula") -> str:
    """f1, auroc, direction, threshold, positives, rows per key, from (keys, v, y)."""
    return f"""
SELECT {keys},
 CASE WHEN pos = 0 OR pos = tot OR var < 1e-20 THEN 0.0::DOUBLE ELSE best.f1 END AS f1,
 CASE WHEN pos = 0 OR pos = tot THEN 0.5::DOUBLE ELSE greatest(u / (pos::DOUBLE * (tot - pos)), 1.0::DOUBLE - u / (pos::DOUBLE * (tot - pos))) END AS auroc,
 best.direction AS direction, best.threshold AS threshold, pos AS positives, tot AS "rows"
FROM (
 SELECT {keys}, max(greatest(
   struct_pack(f1 := 2.0::DOUBLE * tp / (np + pos), direction := 1, threshold := v),
   struct_pack(f1 := 2.0::DOUBLE * (pos - tp + p) / (tot - np + n + pos), direction := -1, threshold := -v))) AS best,
  sum(p::DOUBLE * ((tot - pos) - (np - tp) + (n - p) / 2.0::DOUBLE)) AS u, max(pos) AS pos, max(tot) AS tot, max(var) AS var
 FROM (
  SELECT *, (sum(p) OVER (PARTITION BY {keys} ORDER BY v DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS tp,
   (sum(n) OVER (PARTITION BY {keys} ORDER BY v DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS np,
   (sum(p) OVER (PARTITION BY {keys}))::BIGINT AS pos, (sum(n) OVER (PARTITION BY {keys}))::BIGINT AS tot,
   CASE WHEN count(*) OVER (PARTITION BY {keys}) = 1 THEN 0.0 ELSE 1.0 END AS var
  FROM (SELECT {keys}, v, sum(y)::BIGINT AS p, count(*) AS n FROM ({values}) GROUP BY {keys}, v)
 ) GROUP BY {keys}
)"""


def sql_percentile_f1(values: str, percentiles: Sequence[float], keys: str = "formula", both: bool = True) -> str:
    """Best (f1, threshold, direction) over percentile cuts; ties: lowest percentile, then ``>``."""
    ps = ", ".join(f"({q}::DOUBLE)" for q in percentiles)
    return f"""
SELECT {keys}, b.f1 AS f1, CASE WHEN b.f1 > 0 THEN b.threshold ELSE 0.0::DOUBLE END AS threshold,
 CASE WHEN b.f1 > 0 THEN b.direction ELSE '>' END AS direction
FROM (SELECT {keys}, max(struct_pack(f1 := f1, q := -q, direction := direction, threshold := t)) AS b
 FROM ({sql_cuts(values, ps, keys, both)}) GROUP BY {keys})"""


def sql_cuts(values: str, ps: str, keys: str = "formula", both: bool = True) -> str:
    on = " AND ".join(f"d.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    sides = [
        "SELECT *, '>' AS direction, gtp AS tp, gtn AS predicted FROM sums",
        "SELECT *, '<' AS direction, ltp AS tp, ltn AS predicted FROM sums",
    ][: 2 if both else 1]
    return f"""
WITH vals AS MATERIALIZED ({values}),
 qs(q) AS (VALUES {ps}),
 arr AS (SELECT {keys}, list(v ORDER BY v) AS vs, count(*) AS tot, sum(y)::BIGINT AS pos FROM vals GROUP BY {keys}),
 ranked AS (SELECT {keys}, q, tot, pos, (tot - 1) * q / 100.0::DOUBLE AS r, vs FROM arr, qs),
 cuts AS (SELECT {keys}, q, tot, pos, CASE WHEN vs[floor(r)::BIGINT + 1] = vs[ceil(r)::BIGINT + 1] THEN vs[floor(r)::BIGINT + 1]
   ELSE vs[floor(r)::BIGINT + 1] + (vs[ceil(r)::BIGINT + 1] - vs[floor(r)::BIGINT + 1]) * (r - floor(r)) END AS t FROM ranked),
 d AS (SELECT {keys}, v, sum(y)::BIGINT AS p, count(*) AS n FROM vals GROUP BY {keys}, v),
 sums AS (SELECT {cols}, q, t, any_value(pos) AS pos, any_value(tot) AS tot,
   coalesce(sum(p) FILTER (v > t), 0)::BIGINT AS gtp, coalesce(sum(n) FILTER (v > t), 0)::BIGINT AS gtn,
   coalesce(sum(p) FILTER (v < t), 0)::BIGINT AS ltp, coalesce(sum(n) FILTER (v < t), 0)::BIGINT AS ltn
   FROM cuts c JOIN d ON {on} GROUP BY {cols}, q, t)
SELECT {keys}, q, t, pos, tot, direction, tp, predicted, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (predicted + pos) ELSE 0.0::DOUBLE END AS f1
FROM ({" UNION ALL ".join(sides)})"""


#: Entropy of the columns {k} of a table o.
ENTROPY_SQL = "(SELECT -sum(p * ln(p + 1e-30)) FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM o GROUP BY {k}))"


def binned_sql(cols=("qty", "price", "disc", "tax"), bins: int = 10) -> str:
    """Columns replaced by their percentile bin."""
    qs = "[" + ", ".join(f"{(i + 1) / bins}::DOUBLE" for i in range(bins - 1)) + "]"
    cuts = ", ".join(f"quantile_cont({c}, {qs}) AS q_{c}" for c in cols)
    b = ", ".join(f"len(list_filter(q_{c}, lambda x: x <= {c}))::INTEGER AS {c}" for c in cols)
    return f"(SELECT y, {b} FROM {ITEMS}, (SELECT {cuts} FROM {ITEMS}))"

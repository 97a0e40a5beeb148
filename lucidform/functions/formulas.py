"""The formula operators, as Columns for plans and as array functions for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The guard added to denominators and logarithms, the finite
# stand-ins for infinities, and the exponent clip.
EPS = 1e-30
BIG = 1e10
CLIP = 500.0


def sanitize(c: Column) -> Column:
    """NULL and NaN become 0, +inf becomes 1e10, -inf becomes -1e10."""
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(0.0))
        .when(c == F.lit(float("inf")), F.lit(BIG))
        .when(c == F.lit(float("-inf")), F.lit(-BIG))
        .otherwise(c)
    )


def sanitize_array(v: np.ndarray) -> np.ndarray:
    if not np.isfinite(v).all():
        return np.nan_to_num(v, nan=0.0, posinf=BIG, neginf=-BIG)
    return v


def _ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    # a zero denominator gives 0, as try_divide followed by sanitize does
    return np.divide(num, den, out=np.zeros_like(den), where=den != 0)


@dataclass(frozen=True)
class Op:
    """A formula operator.

    ``column`` builds the Catalyst expression.  ``array`` is the batch form the
    screening kernel uses; it may be omitted, and then formulas with this
    operator are scored by the exact path only.
    """

    name: str
    arity: int
    column: Callable[..., Column]
    array: Callable[..., np.ndarray] | None = None
    commutative: bool = False
    monotone: bool = False


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-CLIP)), F.lit(CLIP))


BINARY: dict[str, Op] = {
    o.name: o
    for o in (
        Op("+", 2, lambda a, b: a + b, lambda a, b: a + b, commutative=True),
        Op("-", 2, lambda a, b: a - b, lambda a, b: a - b),
        Op("*", 2, lambda a, b: a * b, lambda a, b: a * b, commutative=True),
        Op("/", 2, lambda a, b: F.try_divide(a, b + EPS), lambda a, b: _ratio(a, b + EPS)),
        Op("max", 2, lambda a, b: F.greatest(a, b), np.maximum, commutative=True),
        Op("min", 2, lambda a, b: F.least(a, b), np.minimum, commutative=True),
        Op(
            "hypot",
            2,
            lambda a, b: F.sqrt(a * a + b * b),
            lambda a, b: np.sqrt(a * a + b * b),
            commutative=True,
        ),
        Op(
            "diff_sq",
            2,
            lambda a, b: (a - b) * (a - b),
            lambda a, b: (a - b) * (a - b),
            commutative=True,
        ),
        Op(
            "harmonic",
            2,
            lambda a, b: F.try_divide(F.lit(2.0) * a * b, a + b + EPS),
            lambda a, b: _ratio(2.0 * a * b, a + b + EPS),
            commutative=True,
        ),
        Op(
            "geometric",
            2,
            lambda a, b: F.signum(a * b) * F.sqrt(F.abs(a * b)),
            lambda a, b: np.sign(a * b) * np.sqrt(np.abs(a * b)),
            commutative=True,
        ),
    )
}

UNARY: dict[str, Op] = {
    o.name: o
    for o in (
        Op("log", 1, lambda x: F.ln(F.abs(x) + EPS), lambda x: np.log(np.abs(x) + EPS)),
        Op("sqrt", 1, lambda x: F.sqrt(F.abs(x)), lambda x: np.sqrt(np.abs(x))),
        Op("sq", 1, lambda x: x * x, lambda x: x * x),
        Op(
            "inv",
            1,
            lambda x: F.try_divide(F.lit(1.0), x + EPS),
            lambda x: _ratio(np.ones_like(x), x + EPS),
        ),
        Op("neg", 1, lambda x: -x, lambda x: -x, monotone=True),
        Op("abs", 1, lambda x: F.abs(x), np.abs),
        Op(
            "sigmoid",
            1,
            lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-_clip(x))),
            lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -CLIP, CLIP))),
            monotone=True,
        ),
        Op("tanh", 1, lambda x: F.tanh(_clip(x)), lambda x: np.tanh(np.clip(x, -CLIP, CLIP)), monotone=True),
    )
}

# Operator sets by name.
PRESETS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "full": (
        ("+", "-", "*", "/", "max", "min", "hypot", "diff_sq", "harmonic", "geometric"),
        ("log", "sqrt", "sq", "inv", "neg", "abs", "sigmoid", "tanh"),
    ),
    "beam": (
        ("+", "-", "*", "/", "max", "min", "hypot", "diff_sq", "harmonic", "geometric"),
        ("log", "sqrt", "sq", "abs", "sigmoid", "tanh"),
    ),
    "minimal": (("+", "-", "*", "/"), ("log", "sqrt", "sq", "abs", "neg")),
    "benchmark": (("+", "-", "*", "/", "max", "min", "hypot"), ("log", "sqrt", "sq", "inv", "neg")),
}


@dataclass(frozen=True)
class OpSet:
    """Named operators available to a search, built in or supplied by the user."""

    binary: dict[str, Op] = field(default_factory=lambda: dict(BINARY))
    unary: dict[str, Op] = field(default_factory=lambda: dict(UNARY))

    @staticmethod
    def preset(name: str) -> OpSet:
        b, u = PRESETS[name]
        return OpSet({k: BINARY[k] for k in b}, {k: UNARY[k] for k in u})

    @staticmethod
    def of(binary: dict[str, Callable], unary: dict[str, Callable]) -> OpSet:
        """User operators given as functions on Columns."""
        return OpSet(
            {k: Op(k, 2, f) for k, f in binary.items()},
            {k: Op(k, 1, f) for k, f in unary.items()},
        )

    def extended(self, *ops: Op) -> OpSet:
        b, u = dict(self.binary), dict(self.unary)
        for o in ops:
            (b if o.arity == 2 else u)[o.name] = o
        return OpSet(b, u)

    def without(self, name: str) -> OpSet:
        return OpSet(
            {k: v for k, v in self.binary.items() if k != name},
            {k: v for k, v in self.unary.items() if k != name},
        )

    def op(self, name: str, arity: int) -> Op:
        return (self.binary if arity == 2 else self.unary)[name]

    @property
    def vectorised(self) -> bool:
        return all(o.array is not None for o in (*self.binary.values(), *self.unary.values()))


def python_op(name: str, arity: int, fn: Callable[..., np.ndarray], **flags) -> Op:
    """An opaque array function as an operator; plans reach it through a pandas UDF."""
    if arity == 2:

        @F.pandas_udf("double")
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(dtype=float), b.to_numpy(dtype=float)))
    else:

        @F.pandas_udf("double")
        def call(a: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(dtype=float)))

    return Op(name, arity, call, fn, **flags)


# Maps used to check that scores survive increasing transforms.
CHECK_TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x,
    "affine": lambda x: F.lit(2.0) * x + F.lit(3.0),
    "cube": lambda x: x * x * x,
    "exp": lambda x: F.exp(_clip(x)),
    "sin": lambda x: F.sin(x),
    "inv_pos": lambda x: F.lit(1.0) / (F.abs(x) + EPS),
    "sigmoid": UNARY["sigmoid"].column,
    "tanh": UNARY["tanh"].column,
    "neg": UNARY["neg"].column,
    "sqrt": UNARY["sqrt"].column,
    "log": UNARY["log"].column,
}

# Row-wise feature maps.
FEATURE_TRANSFORMS: dict[str, Callable[..., Column]] = {
    "log10p1": lambda x: F.log10(x + F.lit(1.0)),
    "inv_eps": lambda x: F.lit(1.0) / (x + F.lit(1e-10)),
    "inv_cube": lambda x: F.lit(1.0) / (x * x * x + F.lit(1e-10)),
    "square": lambda x: x * x,
    "neg_part": lambda x: F.when(x < 0, -x).otherwise(F.lit(0.0)),
    "ratio": lambda x, y: x / (y + F.lit(1e-10)),
    "product": lambda x, y: x * y,
    "sum": lambda x, y: x + y,
}

"""Scoring a stream with a found formula.

Replay and thresholding are stateless Column expressions, so the batch functions
run on a streaming DataFrame as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import Trace, replay
from lucidform.operators.scoring import predict


def score_stream(
    stream: DataFrame,
    features: Sequence[str],
    trace: Trace,
    direction: int,
    threshold: float,
    ops: OpSet | None = None,
    name: str = "score",
) -> DataFrame:
    """The stream plus the formula's value (``name``) and ``predicted``."""
    return replay(stream, features, trace, name, ops).withColumn("predicted", predict(F.col(name), direction, threshold))

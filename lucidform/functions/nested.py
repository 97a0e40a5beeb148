"""Nested integer grids as text and for equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_grid(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda row: F.array_join(row, " ")), "\n")


def format_task_prompt(train: Column, test_input: Column) -> Column:
    """``train`` is an array of structs with fields input and output."""
    shown = F.transform(
        train,
        lambda pair, i: F.concat(
            F.lit("Example "),
            (i + 1).cast("string"),
            F.lit(":\nInput:\n"),
            format_grid(pair["input"]),
            F.lit("\nOutput:\n"),
            format_grid(pair["output"]),
        ),
    )
    return F.concat(F.array_join(shown, "\n\n"), F.lit("\n\nTest input:\n"), format_grid(test_input))


def grids_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)

"""Vectors of three columns: plain expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vector(column: Column) -> Vec:
    return tuple(F.get(column, F.lit(c)).cast("double") for c in range(3))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def number(x: Column) -> Column:
    """Null for NaN and null: NaN would pass comparisons as the greatest value."""
    return F.when(~F.isnan(x), x)

"""Plan-shape helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """Compute ``cols`` once per row.

    The optimizer merges adjacent projections and copies an expression into
    every place that uses it - including lambda bodies that run per array
    element and Python UDF calls that each cost a trip to Python.  A one-row
    generator between the steps keeps each value computed once.
    """
    packed = F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.select(*keep, packed)

"""Aggregates by the type names of configurations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.types import INTEGERS, family

AGGREGATES = ("count", "sum", "avg", "min", "max", "std", "bit_xor")


def aggregate(kind: str, column: Column | None = None, of: T.DataType | None = None) -> Column:
    """Column of the aggregate ``kind``; without a column, count counts rows.

    Sums are wide: those of integers are decimals of 38 digits.  A sum that leaves
    even those is an error, never null, so that two sides can't agree by it.
    """
    if kind == "count":
        return F.count(F.lit(1) if column is None else column)
    if column is None:
        raise ValueError(f"the aggregate {kind} needs a column")
    name = family(of) if of is not None else ""
    if kind == "sum":
        if name in INTEGERS:
            column = column.cast("decimal(38,0)")
        total = F.try_sum(column)
        return F.when(total.isNull() & (F.count(column) > 0), F.raise_error(F.lit("a sum has more than 38 digits"))).otherwise(total)
    if kind == "avg":
        return F.avg(column)
    if kind == "min":
        return F.min(column)
    if kind == "max":
        return F.max(column)
    if kind == "std":
        if name in ("date", "timestamp"):
            raise ValueError("std isn't defined for dates and timestamps")
        return F.stddev_samp(column)
    if kind == "bit_xor":
        return F.bit_xor(column.cast("bigint"))
    raise ValueError(f"unknown aggregate: {kind}")

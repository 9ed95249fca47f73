"""Partition generation: key ranges of equal numbers of rows, as SQL predicates and configuration files."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.plans.frames import SOURCE, TARGET, actual, filtered
from concord.plans.spec import Filter, ValidationSpec, dump_specs

MOST_FILES = 10_000


def numbered(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int, DataFrame]:
    """(keys with their position from 1 in key order, number of rows, what to unpersist).

    Rows are ranged and sorted by key; a position is a row's place in its task plus
    the rows of the tasks before, of which there is one count each.
    """
    names = [actual(df, k) for k in keys]
    ranged = df.select(*[F.col(f"`{n}`") for n in names]).orderBy(*[F.col(f"`{n}`") for n in names]).withColumn("place", F.monotonically_increasing_id()).persist()
    task = F.shiftright("place", 33)
    before, offsets = 0, []
    for number, rows in sorted(ranged.groupBy(task).count().collect()):
        offsets.append((number, before))
        before += rows
    starts = df.sparkSession.createDataFrame(offsets, "task long, before long")
    inner = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    out = ranged.withColumn("task", task).join(F.broadcast(starts), "task").select(*[F.col(f"`{n}`") for n in names], (F.col("before") + inner + 1).alias("position"))
    return out, before, ranged


def boundaries(df: DataFrame, keys: Sequence[str], partitions: int) -> list[tuple]:
    """Keys of the first row of each of ``partitions`` ranges of as many rows (of fewer rows: each row); null keys don't count."""
    for k in keys:
        df = df.where(F.col(f"`{actual(df, k)}`").isNotNull())
    rows, n, cached = numbered(df, keys)
    parts = min(partitions, n)
    try:
        if not parts:
            return []
        rest = F.pmod(F.col("position").cast("decimal(38,0)") * parts, F.lit(n).cast("decimal(38,0)"))
        first = F.lit(True) if parts == n else (rest > 0) & (rest <= parts)
        return [tuple(r)[:-1] for r in rows.where(first).orderBy("position").collect()]
    finally:
        cached.unpersist()


def literal(value) -> str:
    """SQL text of a key's value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, int | float | Decimal):
        return str(value)
    if isinstance(value, bytes | bytearray):
        return f"X'{bytes(value).hex().upper()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"


def before(keys: Sequence[str], values: Sequence) -> str:
    """Predicate of rows before a key in order, in a form whose comparisons can be pushed to the scan."""
    k, v = f"`{keys[0]}`", literal(values[0])
    return f"{k} < {v}" if len(keys) == 1 else f"({k} < {v} OR ({k} = {v} AND {before(keys[1:], values[1:])}))"


def from_on(keys: Sequence[str], values: Sequence) -> str:
    """Predicate of a key's row and those after."""
    k, v = f"`{keys[0]}`", literal(values[0])
    return f"{k} >= {v}" if len(keys) == 1 else f"({k} > {v} OR ({k} = {v} AND {from_on(keys[1:], values[1:])}))"


def range_predicates(keys: Sequence[str], firsts: Sequence[Sequence]) -> list[str]:
    """One predicate for each range; the first is open below, the last above, a single one takes all."""
    if len(firsts) <= 1:
        return ["TRUE"]
    middle = [f"{from_on(keys, a)} AND {before(keys, b)}" for a, b in zip(firsts[1:], firsts[2:])]
    return [before(keys, firsts[1]), *middle, from_on(keys, firsts[-1])]


def range_number(df: DataFrame, keys: Sequence[str], firsts: Sequence[Sequence]) -> Column:
    """Column: number of the range, from 0, that a row is in; null without a whole key.

    A row is compared with the first key of each of about sqrt(n) runs of ranges, and
    then with the keys of its run.
    """
    names = [actual(df, k) for k in keys]
    kinds = [df.schema[n].dataType for n in names]
    one = lambda values: F.struct(*[F.lit(v).cast(kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(values, kinds, strict=True))])
    own = F.struct(*[F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)])
    known = reduce(lambda x, y: x & y, [F.col(f"`{n}`").isNotNull() for n in names])
    starts = list(firsts[1:])
    if not starts:
        return F.when(known, F.lit(0))
    width = math.isqrt(len(starts) - 1) + 1
    runs = [F.array(*[one(x) for x in starts[i : i + width]]) for i in range(0, len(starts), width)]
    reached = lambda array: F.size(F.filter(array, lambda x: x <= own))
    run = reached(F.array(*[one(starts[i]) for i in range(0, len(starts), width)]))
    return F.when(known, F.when(run == 0, F.lit(0)).otherwise((run - 1) * width + reached(F.element_at(F.array(*runs), F.greatest(run, F.lit(1))))))


def partition_filters(source: DataFrame, target: DataFrame, spec: ValidationSpec, partitions: int) -> list[Filter]:
    """A filter for each range of the source's keys; the spec's own filters apply before."""
    if not spec.primary_keys:
        raise ValueError("partitions need primary keys")
    s, t = filtered(source, spec.filters, SOURCE), filtered(target, spec.filters, TARGET)
    a, b = s.count(), t.count()
    if abs(a - b) > a * 0.1:
        logging.warning("source and target differ by more than 10 %% in rows: %s and %s; partitions may be uneven", a, b)
    mine, theirs = ([actual(df, getattr(k, side)) for k in spec.primary_keys] for df, side in ((s, "source"), (t, "target")))
    firsts = boundaries(s, mine, partitions)
    return [Filter("custom", x, y) for x, y in zip(range_predicates(mine, firsts), range_predicates(theirs, firsts), strict=True)]


def partition_documents(spec: ValidationSpec, filters: Sequence[Filter], parts_per_file: int = 1, source: str | None = None, target: str | None = None) -> dict[str, dict]:
    """Configuration documents by file name, "0000.yaml" on, of a validation for each filter."""
    files = math.ceil(len(filters) / parts_per_file)
    if files > MOST_FILES:
        raise ValueError(f"{files} files are more than {MOST_FILES}: raise the parts of a file or lower the partitions")
    return {
        f"{i:04}.yaml": dump_specs([spec.with_filter(f) for f in filters[i * parts_per_file : (i + 1) * parts_per_file]], source, target, spec.result_handler)
        for i in range(files)
    }

"""The comparison kernel: two results with equal columns become one report.

Both sides meet in one full outer join on null-safe keys; all fields of a joined row
are then unpivoted at once, so each side is read once whatever the number of fields.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.scalars import json_text
from concord.functions.types import INTEGERS, family

#: The columns of a report, in order.
REPORT = (
    "validation_name", "validation_type", "aggregation_type", "source_table_name", "source_column_name", "source_agg_value",
    "target_table_name", "target_column_name", "target_agg_value", "group_by_columns", "primary_keys", "num_random_rows",
    "difference", "pct_difference", "pct_threshold", "validation_status", "run_id", "labels", "start_time", "end_time",
)
NO_PARTS = "array<struct<validation_name:string,aggregation_type:string,source_column_name:string,target_column_name:string,source_agg_value:string,target_agg_value:string,g:string,has_s:boolean,has_t:boolean,numeric:boolean,a:double,b:double,d:double,same:boolean>>"
LABELS = "array<struct<key:string,value:string>>"


@dataclass(frozen=True)
class ReportedField:
    """What is said of a compared field besides its values."""

    alias: str
    source_column: str | None = None
    target_column: str | None = None
    aggregation: str | None = None


@dataclass(frozen=True)
class RunInfo:
    """A run's identity and labels."""

    labels: Sequence[tuple[str, str]] = ()
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    start: datetime = field(default_factory=lambda: datetime.now(UTC))


@dataclass(frozen=True)
class Comparison:
    """How to compare: field metadata, keys, threshold; ``values``: equality only, as of rows;
    ``exact``: decimals as they are rather than as rounded floats; ``named``: whether table names stand in every row."""

    fields: tuple[ReportedField, ...]
    keys: tuple[str, ...] = ()
    validation_type: str = "Column"
    source_table: str | None = None
    target_table: str | None = None
    threshold: float = 0.0
    values: bool = False
    exact: bool = False
    named: bool = True
    primary_keys: tuple[str, ...] = ()
    num_random_rows: int | None = None


def normalised(s: Column, t: Column, source: T.DataType, target: T.DataType, exact: bool) -> tuple[Column, Column, str]:
    """Both values in comparable form, and the form: time, boolean, float, integer, decimal or text.

    Temporal values become whole seconds; decimals and doubles floats rounded to
    four digits, unless ``exact``; NaN becomes null.
    """
    a, b = family(source), family(target)
    kinds = {a, b}
    if kinds <= {"date", "timestamp"}:
        return F.unix_timestamp(s), F.unix_timestamp(t), "time"
    if "boolean" in kinds:
        return s.try_cast("boolean"), t.try_cast("boolean"), "boolean"
    if kinds <= INTEGERS or {a, b} <= INTEGERS | {"decimal"} and all(getattr(x, "scale", 0) == 0 for x in (source, target)):
        return s.cast("decimal(38,0)"), t.cast("decimal(38,0)"), "integer"
    if kinds <= INTEGERS | {"decimal"} and exact:
        return s, t, "decimal"
    if kinds <= INTEGERS | {"decimal", "float32", "float64"}:
        rounded = a in ("decimal", "float64") and not exact
        one = lambda c: F.round(c.cast("float"), 4) if rounded else c.cast("double")
        known = lambda c: F.when(~F.isnan(c), c)
        return known(one(s)), known(one(t)), "float"
    return s.cast("string"), t.cast("string"), "text"


def measured(s: Column, t: Column, source: T.DataType, target: T.DataType, c: Comparison) -> dict[str, Column]:
    """What decides about a pair of values: whether numbers count, the values and their difference as doubles, whether they are equal."""
    a, b, form = normalised(s, t, source, target, c.exact)
    numeric = not c.values and form not in ("text", "boolean")
    none = F.lit(None).cast("double")
    return {
        "numeric": F.lit(numeric),
        "a": a.cast("double") if numeric else none,
        "b": b.cast("double") if numeric else none,
        "d": (b - a).cast("double") if numeric else none,
        "same": F.lit(False) if numeric else a.eqNullSafe(b),
    }


def verdict(c: Comparison) -> tuple[Column, Column]:
    """(pct_difference, status) of measured values."""
    a, b, d = F.col("x.a"), F.col("x.b"), F.col("x.d")
    narrow = d if c.exact else d.cast("float").cast("double")
    pct = F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(100.0) * narrow, F.when(a == 0, b).otherwise(a)))
    success, fail = F.lit("success"), F.lit("fail")
    # one value null: neither a difference nor a pass
    numbers = F.when(a.isNull() & b.isNull(), success).when(a.isNull() | b.isNull(), fail).when(pct.isNull() | F.isnan(pct) | (F.abs(pct) > c.threshold), fail).otherwise(success)
    return pct, F.when(F.col("x.numeric"), numbers).when(F.col("x.same"), success).otherwise(fail)


def plain(column: Column, kind: T.DataType) -> Column:
    """A value as report text: binary as hex."""
    return F.lower(F.hex(column)) if family(kind) == "binary" else column.cast("string")


def single(df: DataFrame, side: str) -> DataFrame:
    """The only row of a side without keys; more than one is an error."""
    few = df.agg(F.count(F.lit(1)).alias("n"), F.first(side).alias(side), F.first(f"in_{side}").alias(f"in_{side}")).where("n > 0")
    only = F.when(F.col("n") > 1, F.raise_error(F.lit("without keys each side has one row at most; give primary keys or groups"))).otherwise(F.lit(1))
    return few.select(only.cast("int").alias("one"), side, f"in_{side}")


def compare(source: DataFrame, target: DataFrame, c: Comparison, run: RunInfo | None = None) -> DataFrame:
    """Report of two results whose columns have equal names in equal order.

    A key on one side only gives failures without numbers.  Rows whose keys repeat
    are compared pairwise.
    """
    if source.columns != target.columns:
        raise ValueError(f"the columns of source and target differ: {source.columns} and {target.columns}")
    run = run or RunInfo()
    kinds, others = ({f.name: f.dataType for f in df.schema.fields} for df in (source, target))
    shown = [f for f in c.fields if f.alias in kinds and (f.alias not in c.keys or "hash__all" in c.keys)]
    place = {k: i for i, k in enumerate(c.keys)}
    left, right = (
        df.select(
            F.struct(F.lit(True).alias("_"), *[F.col(f"`{f.alias}`") for f in shown if f.alias not in place]).alias(side),
            F.lit(True).alias(f"in_{side}"),
            *[F.col(f"`{k}`").alias(f"{side}k{i}") for k, i in place.items()],
        )
        for df, side in ((source, "s"), (target, "t"))
    )
    s, t = (lambda x: F.col(f"sk{place[x]}") if x in place else F.col("s")[x]), (lambda x: F.col(f"tk{place[x]}") if x in place else F.col("t")[x])
    if c.keys:
        on = reduce(lambda a, b: a & b, [F.col(f"sk{i}").eqNullSafe(F.col(f"tk{i}")) for i in range(len(c.keys))])
        joined = left.join(right, on, "full_outer")
    else:
        joined = single(left, "s").join(single(right, "t"), "one", "full_outer")
    group = F.lit(None).cast("string")
    if c.keys:
        texts = [F.concat(F.lit(f'"{k}": "'), json_text(F.when(F.col("in_s").isNotNull(), s(k)).otherwise(t(k).cast(kinds[k])), kinds[k]), F.lit('"')) for k in c.keys]
        group = F.concat(F.lit("{"), F.concat_ws(", ", *texts), F.lit("}"))
    joined = joined.withColumns({"g": group, "has_s": F.col("in_s").isNotNull(), "has_t": F.col("in_t").isNotNull()})
    parts = []
    for f in shown:
        values = {
            "validation_name": F.lit(f.alias),
            "aggregation_type": F.lit(f.aggregation).cast("string"),
            "source_column_name": F.lit(f.source_column).cast("string"),
            "target_column_name": F.lit(f.target_column).cast("string"),
            "source_agg_value": plain(s(f.alias), kinds[f.alias]),
            "target_agg_value": plain(t(f.alias), others[f.alias]),
            "g": F.col("g"),
            "has_s": F.col("has_s"),
            "has_t": F.col("has_t"),
        } | measured(s(f.alias), t(f.alias), kinds[f.alias], others[f.alias], c)
        parts.append(F.struct(*[v.alias(n) for n, v in values.items()]))
    # an element holds all that is needed later, and what follows is computed once, whatever the number of fields
    rows = joined.select(F.explode(F.array(*parts) if parts else F.array().cast(NO_PARTS)).alias("x"))
    in_s, in_t = F.col("x.has_s"), F.col("x.has_t")
    both = in_s & in_t
    pct, status = verdict(c)
    name = lambda table, here: F.lit(table).cast("string") if c.named else F.when(here, F.lit(table).cast("string"))
    keys = "{" + ", ".join(c.primary_keys) + "}" if c.primary_keys else None
    columns = {
        "validation_type": F.lit(c.validation_type),
        "source_table_name": name(c.source_table, in_s),
        "source_column_name": F.when(in_s, F.col("x.source_column_name")),
        "target_table_name": name(c.target_table, in_t),
        "target_column_name": F.when(in_t, F.col("x.target_column_name")),
        "group_by_columns": F.col("x.g"),
        "primary_keys": F.when(in_s, F.lit(keys).cast("string")),
        "num_random_rows": F.when(in_s, F.lit(c.num_random_rows).cast("bigint")),
        "difference": F.when(both, F.col("x.d")),
        "pct_difference": F.when(both & F.col("x.numeric"), pct),
        "pct_threshold": F.when(both, F.lit(float(c.threshold))),
        "validation_status": F.when(both, status).otherwise(F.lit("fail")),
    }
    return stamped(rows.select(*[(columns[n] if n in columns else F.col(f"x.{n}")).alias(n) for n in REPORT[:16]]), run)


def stamped(rows: DataFrame, run: RunInfo) -> DataFrame:
    """Rows with the run's id, labels and times; the end is now."""
    labels = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in run.labels]) if run.labels else F.array()
    return rows.withColumns({"run_id": F.lit(run.run_id), "labels": labels.cast(LABELS), "start_time": F.lit(run.start).cast("timestamp"), "end_time": F.lit(datetime.now(UTC)).cast("timestamp")})

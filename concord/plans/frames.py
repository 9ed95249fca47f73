"""From a specification to each side's DataFrame: filters, calculated fields by depth, groups, aggregates, limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.aggregates import aggregate
from concord.functions.scalars import scalar, text_of
from concord.functions.types import cast_name, family, is_nested
from concord.plans.spec import FieldPair, Filter, ValidationSpec

SOURCE, TARGET = "source", "target"


def actual(df: DataFrame, name: str) -> str:
    """The column's own spelling of a name in whatever case."""
    own = {c.casefold(): c for c in df.columns}
    if name in df.columns:
        return name
    if name.casefold() not in own:
        raise ValueError(f"no column {name}; there are {df.columns}")
    return own[name.casefold()]


def column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """A column by name, and its type; nested ones can't be compared."""
    name = actual(df, name)
    kind = df.schema[name].dataType
    if is_nested(kind):
        raise ValueError(f"column {name} is nested: only schema validation takes arrays, maps and structs")
    return F.col(f"`{name}`"), kind


def predicate(df: DataFrame, f: Filter, side: str) -> Column:
    """A filter as a condition on one side."""
    if f.kind == "or":
        return reduce(lambda a, b: a | b, [predicate(df, x, side) for x in f.parts])
    value = f.source if side == SOURCE else f.target
    if f.kind == "custom":
        return F.expr(value)
    c = F.col(f"`{actual(df, f.source_column if side == SOURCE else f.target_column)}`")
    if f.kind == "equals":
        return c == value
    if f.kind == "isin":
        values = list(value)
        return reduce(lambda a, b: a | b, [c.isin(values[i : i + ONE_LIST]) for i in range(0, max(len(values), 1), ONE_LIST)])
    return c > value if f.kind == "greater_than" else c < value


#: Most values of one list, as the strictest engine takes them; more are a semi-join or, up to the second number, several lists for an engine to filter by.
ONE_LIST, LONG_LIST = 1000, 16_000
#: Beginning of the names of JDBC catalogs.
JDBC_CATALOG = "concord_jdbc_"


def remote(df: DataFrame) -> bool:
    """Whether a JDBC engine reads the rows, which can filter them before they are sent."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return JDBC_CATALOG in plan or "JDBCRelation(" in plan


def filtered(df: DataFrame, filters: tuple[Filter, ...], side: str) -> DataFrame:
    """Rows that pass all filters; long lists of values become a table to join with."""
    for f in filters:
        values = (f.source if side == SOURCE else f.target) if f.kind == "isin" else ()
        if len(values or ()) > ONE_LIST and (len(values) > LONG_LIST or not remote(df)):
            name = actual(df, f.source_column if side == SOURCE else f.target_column)
            listed = df.sparkSession.createDataFrame([(v,) for v in set(values)], T.StructType([T.StructField(name, df.schema[name].dataType)]))
            df = df.join(listed, name, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
        else:
            df = df.where(predicate(df, f, side))
    return df


def calculated(df: DataFrame, spec: ValidationSpec, side: str) -> DataFrame:
    """Calculated fields added, those of a depth at once; later depths see earlier aliases."""
    for depth in sorted({c.depth for c in spec.calculated_fields}):
        new = {}
        for c in spec.calculated_fields:
            if c.depth == depth:
                names = c.source if side == SOURCE else c.target
                new[c.alias] = scalar(c.kind, [column(df, n) for n in names], c.parameters)
        df = df.withColumns(new)
    return df


def compared(df: DataFrame, pair: FieldPair, side: str, trim: bool = False) -> Column:
    """A key or comparison field: cast, or else without trailing blanks if ``trim`` and text."""
    c, kind = column(df, pair.source if side == SOURCE else pair.target)
    if pair.cast == "string":
        c = text_of(c, kind)
    elif pair.cast:
        c = c.cast(cast_name(pair.cast))
    elif trim and family(kind) == "string":
        c = F.regexp_replace(c, r"\s+$", "")
    return c.alias(pair.alias)


def grouping(df: DataFrame, pair: FieldPair, side: str) -> Column:
    """A group key: cast, or else timestamps by date."""
    c, kind = column(df, pair.source if side == SOURCE else pair.target)
    if pair.cast == "string":
        c = text_of(c, kind)
    elif pair.cast:
        c = c.cast(cast_name(pair.cast))
    elif family(kind) == "timestamp":
        c = F.to_date(c)
    return c.alias(pair.alias)


def aggregates(df: DataFrame, spec: ValidationSpec, side: str) -> list[Column]:
    out = []
    for a in spec.aggregates:
        name = a.source if side == SOURCE else a.target
        c, kind = column(df, name) if name else (None, None)
        x = aggregate(a.kind, c, kind)
        out.append((x.cast(cast_name(a.cast)) if a.cast else x).alias(a.alias))
    return out


def prepared(df: DataFrame, spec: ValidationSpec, side: str) -> DataFrame:
    """Filters and calculated fields, before anything is chosen or summed up."""
    return calculated(filtered(df, spec.filters, side), spec, side)


def aggregated(rows: DataFrame, spec: ValidationSpec, side: str) -> DataFrame:
    """Aggregates of prepared rows by the spec's groups."""
    keys = [grouping(rows, g, side) for g in spec.grouped_columns]
    out = rows.groupBy(*keys).agg(*aggregates(rows, spec, side)) if keys else rows.agg(*aggregates(rows, spec, side))
    return out.limit(spec.limit) if spec.limit else out


def row_values(rows: DataFrame, spec: ValidationSpec, side: str) -> DataFrame:
    """Keys and comparison fields of prepared rows."""
    keys = [compared(rows, k, side, spec.trim_string_pks) for k in spec.primary_keys]
    out = rows.select(*keys, *[compared(rows, f, side) for f in spec.comparison_fields])
    return out.limit(spec.limit) if spec.limit else out


def side_frame(df: DataFrame, spec: ValidationSpec, side: str) -> DataFrame:
    """One side's result."""
    rows = prepared(df, spec, side)
    return row_values(rows, spec, side) if spec.is_row else aggregated(rows, spec, side)

"""Validations: from a specification and two DataFrames to a report."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.compare import Comparison, ReportedField, RunInfo, compare
from concord.operators.kept import kept
from concord.operators.sampling import random_rows
from concord.operators.schemas import validate_schemas
from concord.plans.frames import SOURCE, TARGET, aggregated, grouping, prepared, row_values, side_frame
from concord.plans.spec import CUSTOM_QUERY, ROW, SCHEMA, ValidationSpec


def comparison_of(spec: ValidationSpec, groups: bool = False) -> Comparison:
    """How a specification's results are compared; ``groups``: by group although the rows are the aim."""
    by_row = spec.is_row and not groups
    if by_row:
        fields = [ReportedField(f.alias, f.source, f.target) for f in spec.comparison_fields]
        keys = spec.primary_keys
    else:
        fields = [ReportedField(a.alias, a.source, a.target, a.kind) for a in spec.aggregates]
        keys = spec.grouped_columns
    custom = spec.type == CUSTOM_QUERY
    return Comparison(
        tuple(fields),
        tuple(k.alias for k in keys),
        spec.type,
        None if custom else spec.source_table or None,
        None if custom else spec.target_table or None,
        spec.threshold,
        spec.is_row,
        spec.exact,
        not custom,
        tuple(k.alias for k in spec.primary_keys),
        spec.random_row_batch_size if spec.use_random_rows else None,
    )


def validate(source: DataFrame, target: DataFrame, spec: ValidationSpec, run: RunInfo | None = None, seed: int | None = None, order: bool = True) -> DataFrame:
    """Report of one validation.  Results of SQL queries are expected with lower-case names."""
    run = run or RunInfo(spec.labels)
    if spec.type == SCHEMA:
        return validate_schemas(source.sparkSession, source.schema, target.schema, spec.source_table, spec.target_table, spec.exclusion_columns, spec.allow_list, run)
    if spec.use_random_rows:
        source, target = random_rows(source, target, spec, seed, order)
    if spec.type == ROW and spec.grouped_columns:
        return drill_down(source, target, spec, run)
    if spec.is_row and not spec.primary_keys:
        raise ValueError("row validation needs primary keys")
    return compare(side_frame(source, spec, SOURCE), side_frame(target, spec, TARGET), comparison_of(spec), run)


def on_groups(left: DataFrame, names: list[Column], groups: DataFrame, how: str) -> DataFrame:
    """Rows of ``left`` joined by null-safe equality of ``names`` with the columns k0, k1 and so on of ``groups``."""
    same = [a.eqNullSafe(groups[f"k{i}"].cast(left.select(a).schema[0].dataType)) for i, a in enumerate(names)]
    return left.join(groups, reduce(lambda x, y: x & y, same), how)


def drill_down(source: DataFrame, target: DataFrame, spec: ValidationSpec, run: RunInfo) -> DataFrame:
    """Row validation of those groups only whose aggregates differ.

    Each further group column divides the groups that differ so far; of the last
    one's, groups of more rows than ``max_recursive_query_size`` are reported as they
    are; in the others rows are compared.  Each level is one aggregation of the rows
    that are left, not one query for each group, and is kept, so that a level reads
    either side once.
    """
    if not spec.primary_keys:
        raise ValueError("row validation needs primary keys")
    s, t = prepared(source, spec, SOURCE), prepared(target, spec, TARGET)
    reports = []
    for depth in range(1, len(spec.grouped_columns) + 1):
        level = replace(spec, grouped_columns=spec.grouped_columns[:depth])
        a, b = kept(aggregated(s, level, SOURCE)), kept(aggregated(t, level, TARGET))
        keys = [g.alias for g in level.grouped_columns]
        left, right = (df.select(*[F.col(f"`{k}`").alias(f"{side}k{i}") for i, k in enumerate(keys)], *[F.col(f"`{x.alias}`").alias(f"{side}v{i}") for i, x in enumerate(level.aggregates)], F.lit(True).alias(f"in_{side}")) for df, side in ((a, "s"), (b, "t")))
        both = left.join(right, reduce(lambda x, y: x & y, [F.col(f"sk{i}").eqNullSafe(F.col(f"tk{i}")) for i in range(depth)]), "full_outer")
        further = reduce(lambda x, y: x | y, [~F.col(f"sv{i}").cast("string").eqNullSafe(F.col(f"tv{i}").cast("string")) for i in range(len(level.aggregates))], F.lit(False))
        if depth == len(spec.grouped_columns):
            rows = [F.greatest(F.col(f"sv{i}"), F.col(f"tv{i}")).cast("double") for i, x in enumerate(level.aggregates) if x.kind == "count"]
            further = further & (F.coalesce(F.greatest(*rows, F.lit(0.0)) if rows else F.lit(0.0), F.lit(0.0)) <= spec.max_recursive_query_size)
        groups = kept(both.where(further).select(*[F.when(F.col("in_s"), F.col(f"sk{i}")).otherwise(F.col(f"tk{i}").cast(left.schema[f"sk{i}"].dataType)).alias(f"k{i}") for i in range(depth)]))
        ended = (on_groups(df, [F.col(f"`{k}`") for k in keys], groups, "left_anti") for df in (a, b))
        reports.append(compare(*ended, comparison_of(level, groups=True), run))
        s, t = (on_groups(df, [grouping(df, g, side) for g in level.grouped_columns], groups, "left_semi") for df, side in ((s, SOURCE), (t, TARGET)))
    reports.append(compare(row_values(s, spec, SOURCE), row_values(t, spec, TARGET), comparison_of(spec), run))
    return reduce(DataFrame.unionByName, reports)

"""Type-driven generation of aggregates, row pipelines and keys from two schemas."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

from concord.functions.formats import DATE_FORMAT, TIMESTAMP_FORMAT
from concord.functions.types import NUMBERS, TEMPORAL, family, is_long_decimal, is_nested
from concord.plans.spec import AggregateField, CalculatedField, FieldPair

#: Longest alias; longer ones get a numbered name.  (Old Oracle versions take 30.)
ALIAS_LENGTH = 128
EVERYTHING = "*"
#: Most columns of one concatenation by engine, where there is a limit.
CONCAT_COLUMNS = {"mssql": 254, "oracle": 125, "postgres": 99, "teradata": 500}


def as_list(value: str | Iterable[str] | None) -> list[str] | None:
    """Names of a list or a comma-separated text; None stands for all."""
    if value is None or value == EVERYTHING:
        return None
    return [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value)


def by_name(schema: T.StructType) -> dict[str, T.StructField]:
    return {f.name.casefold(): f for f in schema.fields}


def chosen(schema: T.StructType, columns: Sequence[str] | None, exclude: bool) -> dict[str, T.StructField]:
    """Fields by case-folded name: all, those of ``columns``, or all but those."""
    own = by_name(schema)
    if columns is None:
        if exclude:
            raise ValueError("columns can't be excluded from '*'")
        return own
    listed = {c.casefold() for c in columns}
    return {k: f for k, f in own.items() if (k in listed) != exclude}


#: Fixed value: the name of a column whose own would make an alias too long.
NUMBERED = "dvt_calc_col_{}"


def alias_for(prefix: str, name: str, position: int, longest: int = ALIAS_LENGTH) -> str:
    alias = f"{prefix}__{name}"
    return alias if len(alias) <= longest else f"{prefix}__{NUMBERED.format(position)}"


def expand_aggregates(
    kind: str,
    columns: str | Iterable[str] | None,
    source: T.StructType,
    target: T.StructType,
    exclude: bool = False,
    string_lengths: bool = False,
    timestamps: bool = False,
    bigint: bool = False,
    longest: int = ALIAS_LENGTH,
    bigquery: bool = False,
) -> tuple[list[CalculatedField], list[AggregateField]]:
    """Calculated fields and aggregates of ``kind`` over columns.

    "*" takes numbers, with ``string_lengths`` texts and with ``timestamps`` dates and
    timestamps; named columns may be of those kinds and binary; count takes any.
    Texts are summed up by their length, binary by its bytes, times by their seconds
    (but for min and max), 32-bit integers as 64-bit ones with ``bigint``.
    """
    names = as_list(columns)
    own, others = by_name(source), by_name(target)
    listed = chosen(source, names, exclude)
    takes = NUMBERS | ({"string"} if string_lengths else set()) | (TEMPORAL if timestamps else set())
    if names is not None:
        takes = takes | {"string", "binary"} | TEMPORAL
    fields: dict[str, CalculatedField] = {}
    out = []

    def field(a: str, b: str, calc: str, position: int, depth: int = 0, cast: str | None = None) -> str:
        alias = alias_for(f"{calc}_{cast}" if cast else calc, a, position, longest)
        fields.setdefault(alias, CalculatedField(alias, (a,), (b,), calc, depth, {"default_cast": cast} if cast else {}))
        return alias

    for position, (name, f) in enumerate(own.items()):
        if name not in listed:
            continue
        if name not in others:
            logging.warning("no %s of %s: the target doesn't have it", kind, name)
            continue
        g = others[name]
        a, b = family(f.dataType), family(g.dataType)
        if is_nested(f.dataType) or is_nested(g.dataType) or kind != "count" and not {a, b} <= takes:
            if names is not None and kind != "count":
                logging.info("no %s of %s: its type is %s", kind, name, a)
            if not (kind == "count" and not is_nested(f.dataType)):
                continue
        calc = None
        if a == b == "string":
            calc = field(f.name, g.name, "length", position)
        elif a == "binary" and kind != "count":
            calc = field(f.name, g.name, "byte_length", position)
        elif bigint and a == "int32":
            calc = field(f.name, g.name, "cast", position, cast="int64")
        elif a in TEMPORAL and kind in ("sum", "avg", "bit_xor"):
            first, second, depth = f.name, g.name, 0
            if bigquery:
                first = second = field(f.name, g.name, "cast", position, cast="timestamp")
                depth = 1
            calc = field(first, second, "epoch_seconds", position, depth)
        if calc:
            out.append(AggregateField(alias_for(kind, calc, position, longest), calc, calc, None, kind))
        else:
            cast = "string" if is_long_decimal(f.dataType) and is_long_decimal(g.dataType) else None
            out.append(AggregateField(alias_for(kind, name, position, longest), f.name, g.name, cast, kind))
    return list(fields.values()), out


COUNT_ROWS = AggregateField("count", None, None, None, "count")


def column_validation(source: T.StructType, target: T.StructType, wanted: dict[str, str | Iterable[str] | None], **options) -> tuple[tuple[CalculatedField, ...], tuple[AggregateField, ...]]:
    """Calculated fields and aggregates of column validation: rows are always counted; ``wanted`` maps kinds to columns."""
    fields: dict[str, CalculatedField] = {}
    out = [COUNT_ROWS]
    for kind, columns in wanted.items():
        new, more = expand_aggregates(kind, columns, source, target, **options)
        fields |= {f.alias: f for f in new}
        out += more
    return tuple(fields.values()), tuple(out)


def key_pairs(columns: str | Iterable[str], source: T.StructType, target: T.StructType) -> tuple[FieldPair, ...]:
    """Keys or groups; long decimals on both sides, and binary on either, become text."""
    own, others, out = by_name(source), by_name(target), []
    for name in as_list(columns) or []:
        if name.casefold() not in own or name.casefold() not in others:
            raise ValueError(f"column {name} isn't in {'source' if name.casefold() not in own else 'target'}")
        f, g = own[name.casefold()], others[name.casefold()]
        text = is_long_decimal(f.dataType) and is_long_decimal(g.dataType) or "binary" in (family(f.dataType), family(g.dataType))
        out.append(FieldPair(name, f.name, g.name, "string" if text else None))
    return tuple(out)


def comparison_pairs(columns: str | Iterable[str] | None, source: T.StructType, target: T.StructType, keys: Iterable[str] = (), exclude: bool = False, strip_texts: bool = False) -> tuple[tuple[CalculatedField, ...], tuple[FieldPair, ...]]:
    """Fields compared value by value, without the keys; with ``strip_texts`` texts lose their trailing blanks first."""
    listed, others = chosen(source, as_list(columns), exclude), by_name(target)
    skip = {k.casefold() for k in keys}
    fields, out = [], []
    for name, f in listed.items():
        if name in skip:
            continue
        if name not in others:
            raise ValueError(f"column {name} isn't in target")
        g = others[name]
        kinds = {family(f.dataType), family(g.dataType)}
        if "boolean" in kinds:
            out.append(FieldPair(name, f.name, g.name, "bool"))
        elif strip_texts and "string" in kinds:
            fields.append(CalculatedField(f"rstrip__{name}", (f.name,), (g.name,), "rstrip"))
            out.append(FieldPair(fields[-1].alias, fields[-1].alias, fields[-1].alias))
        else:
            out.append(FieldPair(name, f.name, g.name))
    return tuple(fields), tuple(out)


def row_pipeline(kind: str, columns: str | Iterable[str] | None, source: T.StructType, target: T.StructType, exclude: bool = False, ignore_case: bool = False, longest: int = ALIAS_LENGTH) -> tuple[tuple[CalculatedField, ...], tuple[FieldPair, ...]]:
    """Steps that make one text, and for "hash" its hash, of a row's columns, and the field that is compared.

    Each column is cast to text, its null replaced, its end stripped and, with
    ``ignore_case``, its letters raised; depth by depth, then joined.
    """
    listed, others = chosen(source, as_list(columns), exclude), by_name(target)
    if missing := [n for n in listed if n not in others]:
        raise ValueError(f"columns aren't in target: {missing}")
    steps = ["ifnull", "rstrip"] + (["upper"] if ignore_case else [])
    out, last = [], []
    for position, (name, f) in enumerate(listed.items()):
        g = others[name]
        kinds = {family(f.dataType), family(g.dataType)}
        calc, parameters = "cast", {}
        if kinds <= TEMPORAL:
            pattern = DATE_FORMAT if "date" in kinds else TIMESTAMP_FORMAT
            calc, parameters = "custom", {"ibis_expr": "TemporalValue.strftime", "params": [{"format_str": pattern}]}
        elif "boolean" in kinds:
            parameters = {"default_cast": "bool_string"}
        alias = alias_for("cast", name, position, longest)
        out.append(CalculatedField(alias, (f.name,), (g.name,), calc, 0, parameters))
        for depth, step in enumerate(steps, 1):
            new = alias_for(step, alias, position, longest)
            out.append(CalculatedField(new, (alias,), (alias,), step, depth))
            alias = new
        last.append(alias)
    out.append(CalculatedField("concat__all", tuple(last), tuple(last), "concat", len(steps) + 1))
    if kind == "hash":
        out.append(CalculatedField("hash__all", ("concat__all",), ("concat__all",), "hash", len(steps) + 2))
    name = f"{kind}__all"
    return tuple(out), (FieldPair(name, name, name),)


def column_chunks(columns: Sequence[str], most: int | None) -> list[list[str]]:
    """Columns in lists of ``most`` at most."""
    columns = list(columns)
    return [columns[i : i + most] for i in range(0, len(columns), most)] if most else [columns]


def most_columns(option: int | None, source_engine: str, target_engine: str) -> int | None:
    """Limit of columns in one concatenation: the option, or the lower one of the engines."""
    limits = [CONCAT_COLUMNS[e] for e in (source_engine.lower(), target_engine.lower()) if e in CONCAT_COLUMNS]
    return option or min(limits, default=None)

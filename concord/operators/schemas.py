"""Schema validation: column names and type names of two tables."""

from __future__ import annotations

import itertools
import logging
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from concord.functions.types import schema_names
from concord.operators.compare import RunInfo, stamped

ABSENT = "N/A"
#: Fixed value: the form of one type of an allow-list: an optional "!", a name, and digits, ranges or 'UTC' in parentheses.
LISTED_TYPE = r"!?[a-z0-9 ]+(?:\((?:[0-9 ,\-]+|'UTC')\))?"
DECIMAL = re.compile(r"(!?[a-z0-9]+)\(([0-9\-]+)(?:,([0-9\-]+))?\)", re.IGNORECASE)
#: Schema reports: those of comparisons without pct_difference.
SCHEMA_REPORT = "validation_name string, validation_type string, aggregation_type string, source_table_name string, source_column_name string, source_agg_value string, target_table_name string, target_column_name string, target_agg_value string, group_by_columns string, primary_keys string, num_random_rows long, difference double, pct_threshold double, validation_status string"


class SchemaError(ValueError):
    """An allow-list that can't be read."""


def without_blanks(name: str) -> str:
    return str(name).replace(" ", "")


def numbers(text: str) -> list[str]:
    """The numbers of "5" or of a range "2-5"."""
    low, dash, high = text.partition("-")
    if not dash:
        return [text]
    if not (low.isdigit() and high.isdigit()) or int(low) >= int(high):
        raise SchemaError(f"a range in an allow-list goes from a lower to a higher number: {text}")
    return [str(n) for n in range(int(low), int(high) + 1)]


def expanded(name: str) -> list[str]:
    """All type names that one with ranges of digits stands for."""
    m = DECIMAL.fullmatch(without_blanks(name))
    if not m:
        return [without_blanks(name)]
    digits = [numbers(m[2])] + ([numbers(m[3])] if m[3] else [])
    return [f"{m[1]}({','.join(x)})" for x in itertools.product(*digits)]


def parse_allow_list(text: str) -> dict[str, list[str]]:
    """Target types that are allowed for each source type, of text like "decimal(1-3,0):int64,string:date"."""
    out: dict[str, list[str]] = {}
    for pair in re.findall(f"{LISTED_TYPE}:{LISTED_TYPE}", text or "", re.IGNORECASE):
        source, target = pair.split(":")
        for s, t in itertools.product(expanded(source), expanded(target)):
            out.setdefault(s, []).append(t)
    return out


def allow_list_text(inline: str | None = None, document: dict | None = None) -> str:
    """One allow-list of inline text and of a document {source type: target type or types}."""
    items = [f"{s}:{t}" for s, ts in (document or {}).items() for t in (ts if isinstance(ts, list) else [ts])]
    return ",".join([x for x in [inline] if x] + items)


def is_wider_decimal(source: str, target: str) -> bool:
    """Whether both are decimals, and the target holds all of the source's digits and more of some; "!" doesn't matter."""
    a, b = (DECIMAL.fullmatch(without_blanks(x)) for x in (source, target))
    if not a or not b or {m[1].lstrip("!").lower() for m in (a, b)} != {"decimal"}:
        return False
    s, t = ((int(m[2]), int(m[3] or 0)) for m in (a, b))
    return s != t and s[0] <= t[0] and s[1] <= t[1]


def match_schemas(source: dict[str, str], target: dict[str, str], exclude: Iterable[str] = (), allow_list: str = "") -> list[tuple[str, str, str, str, str]]:
    """(source column, target column, source type, target type, status): the source's columns in order, then the target's others.

    Names match whatever their case.  Equal types pass, pairs of the allow-list, and
    wider decimals.
    """
    left, right = ({k.casefold(): v for k, v in x.items() if k.casefold() not in {e.casefold() for e in exclude}} for x in (source, target))
    allowed, out = parse_allow_list(allow_list), []
    for name, kind in left.items():
        if name not in right:
            out.append((name, ABSENT, kind, ABSENT, "fail"))
            continue
        other = right[name]
        s, t = without_blanks(kind), without_blanks(other)
        if kind == other:
            out.append((name, name, kind, other, "success"))
        elif t in allowed.get(s, ()):
            out.append((name, name, s, other, "success"))
        elif is_wider_decimal(s, t):
            logging.warning("column %s: the target's decimal is wider: %s and %s", name, s, other)
            out.append((name, name, s, other, "success"))
        else:
            out.append((name, name, kind, other, "fail"))
    return out + [(ABSENT, name, ABSENT, kind, "fail") for name, kind in right.items() if name not in left]


def validate_schemas(spark: SparkSession, source: T.StructType, target: T.StructType, source_table: str = "", target_table: str = "", exclude: Iterable[str] = (), allow_list: str = "", run: RunInfo | None = None) -> DataFrame:
    """Report of two schemas; no table is read."""
    rows = [
        ("Schema", "Schema", "Schema", source_table, a, x, target_table, b, y, None, None, None, None, None, status)
        for a, b, x, y, status in match_schemas(schema_names(source), schema_names(target), exclude, allow_list)
    ]
    return stamped(spark.createDataFrame(rows, SCHEMA_REPORT), run or RunInfo())

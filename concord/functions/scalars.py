"""Calculated fields: a registry of scalar functions by the type names of configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import fingerprints
from concord.functions.formats import TIMESTAMP_FORMAT, datetime_pattern, number_pattern
from concord.functions.types import cast_name, family

#: Fixed value: what stands for null in row hashes unless a field names another.
NULL_TEXT = "DEFAULT_REPLACEMENT_STRING"
NUMBER_FORMAT = "FM90.099"

Field = tuple[Column, T.DataType]


def text_of(column: Column, kind: T.DataType) -> Column:
    """Canonical text: booleans true/false, binary lower-case hex, floats and decimals plain, temporal values as in TIMESTAMP_FORMAT."""
    name = family(kind)
    if name == "binary":
        return F.lower(F.hex(column))
    if name == "timestamp":
        return F.date_format(column, datetime_pattern(TIMESTAMP_FORMAT))
    return column.cast("string")


def bool_text(column: Column, kind: T.DataType) -> Column:
    """true or false from booleans, numbers and usual spellings; null stays null."""
    if family(kind) == "string":
        word = F.lower(F.trim(column))
        yes, no = word.isin("true", "t", "yes", "y", "1"), word.isin("false", "f", "no", "n", "0")
        return F.when(yes, F.lit("true")).when(no, F.lit("false")).otherwise(column)
    return F.when(column.cast("boolean"), F.lit("true")).when(column.isNotNull(), F.lit("false"))


def cast(fields: list[Field], p: dict) -> Column:
    column, kind = fields[0]
    to = p.get("default_cast") or "string"
    if to == "bool_string":
        return bool_text(column, kind)
    if to == "string":
        return text_of(column, kind)
    return (column.try_cast if p.get("lenient") else column.cast)(cast_name(to))


def ifnull(fields: list[Field], p: dict) -> Column:
    column, kind = fields[0]
    other = F.lit(p.get("default_null_string", NULL_TEXT))
    return F.coalesce(column, other) if family(kind) == "string" else F.coalesce(text_of(column, kind), other.cast("string"))


def stripped(pattern: str) -> Callable[[list[Field], dict], Column]:
    return lambda fields, p: F.regexp_replace(fields[0][0].cast("string"), pattern, "")


def concat(fields: list[Field], p: dict) -> Column:
    return F.concat_ws(p.get("default_concat_separator", ""), *[text_of(c, k) for c, k in fields])


def hashed(fields: list[Field], p: dict) -> Column:
    text = text_of(*fields[0])
    return fingerprints.farm_fingerprint(text) if p.get("default_hash_function") else F.sha2(text, 256)


def epoch_seconds(fields: list[Field], p: dict) -> Column:
    return F.unix_timestamp(fields[0][0])


def to_char(fields: list[Field], p: dict) -> Column:
    """Number text; FM drops blanks, and zeros at the end where the format has a 9."""
    pattern, bare = number_pattern(p.get("default_to_char_fmt") or NUMBER_FORMAT)
    decimals = pattern.partition(".")[2]
    out = F.to_char(fields[0][0].cast(T.DecimalType(38, len(decimals))), F.lit(pattern))
    if not bare:
        return out
    kept = decimals.rfind("0") + 1
    out = F.trim(out)
    return F.regexp_replace(out, rf"(\.\d{{{kept}}}\d*?)0+$", "$1") if decimals else out


def strftime(fields: list[Field], p: dict) -> Column:
    return F.date_format(fields[0][0], datetime_pattern(p["format_str"]))


def replace(fields: list[Field], p: dict) -> Column:
    return F.replace(fields[0][0].cast("string"), F.lit(p["pattern"]), F.lit(p["replacement"]))


#: Expressions that the type "custom" may name.  None is evaluated as code.
CUSTOM: dict[str, Callable[[list[Field], dict], Column]] = {
    "TemporalValue.strftime": strftime,
    "StringValue.replace": replace,
    "StringValue.upper": lambda f, p: F.upper(f[0][0]),
    "StringValue.lower": lambda f, p: F.lower(f[0][0]),
    "StringValue.strip": lambda f, p: F.regexp_replace(f[0][0], r"^\s+|\s+$", ""),
    "StringValue.lstrip": lambda f, p: F.regexp_replace(f[0][0], r"^\s+", ""),
    "StringValue.rstrip": lambda f, p: F.regexp_replace(f[0][0], r"\s+$", ""),
    "StringValue.length": lambda f, p: F.length(f[0][0]),
    "StringValue.substr": lambda f, p: F.substring(f[0][0], int(p["start"]) + 1, int(p.get("length", 2**31 - 1))),
    "StringValue.re_replace": lambda f, p: F.regexp_replace(f[0][0], p["pattern"], p["replacement"]),
    "NumericValue.abs": lambda f, p: F.abs(f[0][0]),
    "NumericValue.round": lambda f, p: F.round(f[0][0], int(p.get("digits", 0))),
    "NumericValue.floor": lambda f, p: F.floor(f[0][0]),
    "NumericValue.ceil": lambda f, p: F.ceil(f[0][0]),
    "TemporalValue.epoch_seconds": epoch_seconds,
}


def custom(fields: list[Field], p: dict) -> Column:
    """``ibis_expr`` names an entry of CUSTOM by its last two parts; ``params`` is a list of its arguments."""
    name = ".".join(str(p.get("ibis_expr", "")).split(".")[-2:])
    if name not in CUSTOM:
        raise ValueError(f"custom expression isn't on the list of those allowed: {p.get('ibis_expr')}")
    arguments = {k: v for x in p.get("params") or [] for k, v in x.items()}
    return CUSTOM[name](fields, arguments)


SCALARS: dict[str, Callable[[list[Field], dict], Column]] = {
    "cast": cast,
    "force_cast": cast,
    "ifnull": ifnull,
    "rstrip": stripped(r"\s+$"),
    "rtrim": stripped(r"\s+$"),
    "ltrim": stripped(r"^\s+"),
    "upper": lambda f, p: F.upper(f[0][0]),
    "concat": concat,
    "hash": hashed,
    "length": lambda f, p: F.length(f[0][0]),
    "byte_length": lambda f, p: F.octet_length(f[0][0]),
    "epoch_seconds": epoch_seconds,
    "to_char": to_char,
    "custom": custom,
}


def scalar(kind: str, fields: list[Field], parameters: dict | None = None) -> Column:
    """Column of the calculated field type ``kind``."""
    if kind not in SCALARS:
        raise ValueError(f"unknown calculated field type: {kind}")
    if not fields:
        raise ValueError(f"calculated field {kind} names no column")
    return SCALARS[kind](fields, parameters or {})


def json_text(column: Column, kind: T.DataType) -> Column:
    """Key text for reports: null as null, backslashes and quotes escaped."""
    text = F.coalesce(text_of(column, kind) if family(kind) != "timestamp" else column.cast("string"), F.lit("null"))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

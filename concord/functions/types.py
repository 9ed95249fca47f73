"""Names of Spark types as they stand in schema reports, allow-lists and configurations."""

from __future__ import annotations

from pyspark.sql import types as T

SIMPLE = {
    T.ByteType: "int8",
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.StringType: "string",
    T.CharType: "string",
    T.VarcharType: "string",
    T.BooleanType: "boolean",
    T.DateType: "date",
    T.BinaryType: "binary",
    T.TimestampType: "timestamp('UTC')",
    T.TimestampNTZType: "timestamp",
    T.NullType: "null",
}
#: Spark's type for a name of this kind; decimal(p, s) and Spark's own names are taken as they are.
CASTS = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "bool": "boolean",
    "timestamp('UTC')": "timestamp",
}
NUMBERS = frozenset({"int8", "int16", "int32", "int64", "float32", "float64", "decimal"})
INTEGERS = frozenset({"int8", "int16", "int32", "int64"})
TEMPORAL = frozenset({"date", "timestamp"})
#: Most digits for which decimals are compared as numbers.
EXACT_DIGITS = 18


def type_name(kind: T.DataType, nullable: bool = True) -> str:
    """Name of a type; "!" stands before one that can't be null."""
    if isinstance(kind, T.DecimalType):
        name = f"decimal({kind.precision}, {kind.scale})"
    elif isinstance(kind, T.ArrayType):
        name = f"array<{type_name(kind.elementType)}>"
    elif isinstance(kind, T.MapType):
        name = f"map<{type_name(kind.keyType)}, {type_name(kind.valueType)}>"
    elif isinstance(kind, T.StructType):
        name = "struct<" + ", ".join(f"{f.name}: {type_name(f.dataType)}" for f in kind.fields) + ">"
    elif isinstance(kind, T.DayTimeIntervalType | T.YearMonthIntervalType):
        name = "interval"
    else:
        name = SIMPLE.get(type(kind)) or ("time" if kind.simpleString().startswith("time(") else kind.simpleString())
    return name if nullable else f"!{name}"


def family(kind: T.DataType) -> str:
    """Type name without precision, time zone and element types."""
    return type_name(kind).split("(")[0].split("<")[0]


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


def is_long_decimal(kind: T.DataType) -> bool:
    """Whether a decimal has more digits than are compared as numbers."""
    return isinstance(kind, T.DecimalType) and kind.precision > EXACT_DIGITS


def cast_name(name: str) -> str:
    """Spark's name of a cast's target."""
    return CASTS.get(name, name)


def schema_names(schema: T.StructType) -> dict[str, str]:
    """Type name of each column, in order."""
    return {f.name: type_name(f.dataType, f.nullable) for f in schema.fields}

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.aggregates import aggregate
from concord.functions.fingerprints import farm_fingerprint, farm_fingerprint64
from concord.functions.formats import datetime_pattern, number_pattern
from concord.functions.scalars import NULL_TEXT, scalar
from concord.functions.similarity import jaro
from concord.functions.types import family, type_name


def one(spark, kind, value, schema, **parameters):
    df = spark.createDataFrame([(value,)], f"x {schema}")
    return df.select(scalar(kind, [(F.col("x"), df.schema[0].dataType)], parameters)).first()[0]


def test_type_names():
    names = {
        T.ByteType(): "int8", T.ShortType(): "int16", T.IntegerType(): "int32", T.LongType(): "int64", T.FloatType(): "float32", T.DoubleType(): "float64",
        T.DecimalType(10, 2): "decimal(10, 2)", T.StringType(): "string", T.BooleanType(): "boolean", T.DateType(): "date", T.TimestampType(): "timestamp('UTC')",
        T.TimestampNTZType(): "timestamp", T.BinaryType(): "binary", T.ArrayType(T.FloatType()): "array<float32>", T.DayTimeIntervalType(): "interval",
    }
    for kind, name in names.items():
        assert type_name(kind) == name and type_name(kind, False) == f"!{name}"
    assert family(T.DecimalType(3, 1)) == "decimal" and family(T.TimestampType()) == "timestamp"


def test_casts(spark):
    assert one(spark, "cast", 5, "int") == "5" and one(spark, "cast", "7", "string", default_cast="int64") == 7
    assert one(spark, "cast", "x", "string", default_cast="int64", lenient=True) is None
    assert one(spark, "cast", b"\xff\x01", "binary") == "ff01"
    assert one(spark, "cast", datetime(2020, 1, 2, 3, 4, 5, 6), "timestamp_ntz") == "2020-01-02 03:04:05"
    assert one(spark, "cast", date(2020, 1, 2), "date") == "2020-01-02"
    assert one(spark, "cast", Decimal("1.50"), "decimal(10,2)") == "1.50"
    for value, schema, text in ((True, "boolean", "true"), (False, "boolean", "false"), (1, "int", "true"), (0, "int", "false"), ("Y", "string", "true"), ("0 ", "string", "false"), (None, "boolean", None), (None, "string", None)):
        assert one(spark, "cast", value, schema, default_cast="bool_string") == text


def test_texts(spark):
    assert one(spark, "ifnull", None, "string") == NULL_TEXT and one(spark, "ifnull", None, "int", default_null_string="-") == "-" and one(spark, "ifnull", 3, "int") == "3"
    assert one(spark, "rstrip", " a \t\n", "string") == " a" == one(spark, "rtrim", " a  ", "string") and one(spark, "ltrim", " \ta ", "string") == "a "
    assert one(spark, "upper", "aé", "string") == "AÉ" and one(spark, "length", "é", "string") == 1 and one(spark, "byte_length", "é".encode(), "binary") == 2
    assert one(spark, "hash", "a", "string") == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    fields = [(F.col(c), df.schema[c].dataType) for c in df.columns]
    assert df.select(scalar("concat", fields), scalar("concat", fields, {"default_concat_separator": "-"})).first()[:] == ("a3", "a-3")


def test_times_and_numbers(spark):
    assert one(spark, "epoch_seconds", datetime(1970, 1, 1, 0, 1), "timestamp_ntz") == 60 == one(spark, "epoch_seconds", datetime(1970, 1, 1, 0, 1), "timestamp") and one(spark, "epoch_seconds", date(1970, 1, 2), "date") == 86400
    assert one(spark, "to_char", 5, "int", default_to_char_fmt="FM990") == "5" and one(spark, "to_char", Decimal("1.5"), "decimal(5,2)") == "1.5" and one(spark, "to_char", Decimal("1.256"), "decimal(6,3)") == "1.256"


def test_custom_expressions_are_listed(spark):
    assert one(spark, "custom", "abc", "string", ibis_expr="ibis.expr.types.StringValue.replace", params=[{"pattern": "b"}, {"replacement": "X"}]) == "aXc"
    assert one(spark, "custom", datetime(2020, 1, 2), "timestamp", ibis_expr="ibis.expr.types.TemporalValue.strftime", params=[{"format_str": "%d.%m.%Y at %H h"}]) == "02.01.2020 at 00 h"
    for bad in ("__import__('os').system", "", "os.system"):
        with pytest.raises(ValueError):
            one(spark, "custom", "x", "string", ibis_expr=bad)
    with pytest.raises(ValueError):
        scalar("no such type", [])


def test_formats():
    assert datetime_pattern("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss" and datetime_pattern("%d of %b") == "dd 'of' MMM"
    assert number_pattern("FM90.099") == ("90.099", True) and number_pattern("990") == ("990", False)
    with pytest.raises(ValueError):
        datetime_pattern("%Q")


def test_farm_fingerprints(spark):
    # values of the public documentation of FARM_FINGERPRINT
    signed = {"1footrue": -1541654101129638711, "2applefalse": 2794438866806483259, "3true": -4880158226897771312}
    for text, value in signed.items():
        assert (farm_fingerprint64(text.encode()) + 2**63) % 2**64 - 2**63 == value
    df = spark.createDataFrame([*((t, v) for t, v in signed.items()), (None, None)], "t string, v long")
    assert df.where(~farm_fingerprint(F.col("t")).eqNullSafe(F.col("v"))).count() == 0
    assert len({farm_fingerprint64(b"x" * n) for n in range(300)}) == 300


def test_jaro():
    assert jaro("orders", "orders") == 1.0 and jaro("", "a") == 0.0 and jaro("abc", "xyz") == 0.0
    assert round(jaro("orders", "order"), 4) == 0.9444 and round(jaro("MARTHA", "MARHTA"), 4) == 0.9444 and round(jaro("DIXON", "DICKSONX"), 4) == 0.7667


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 2**62, "a"), (2, 2**62, None), (None, 2**62, "b")], "x int, big bigint, s string")
    kinds = {f.name: f.dataType for f in df.schema}
    get = lambda kind, c=None: df.agg(aggregate(kind, None if c is None else F.col(c), kinds.get(c))).first()[0]
    assert (get("count"), get("count", "x"), get("sum", "x"), get("avg", "x"), get("min", "x"), get("max", "x"), get("bit_xor", "x")) == (3, 2, 3, 1.5, 1, 2, 3)
    assert abs(get("std", "x") - 0.7071067811865476) < 1e-12 and get("sum", "big") == 3 * 2**62 and df.limit(0).agg(aggregate("sum", F.col("x"), T.IntegerType())).first()[0] is None
    wide = df.select(F.lit("9" * 38).cast("decimal(38,0)").alias("w"))
    with pytest.raises(Exception, match="38 digits"):
        wide.agg(aggregate("sum", F.col("w"), T.DecimalType(38, 0))).collect()
    for kind, column in (("sum", None), ("median", "x")):
        with pytest.raises(ValueError):
            get(kind, column)
    with pytest.raises(ValueError):
        aggregate("std", F.col("x"), T.DateType())

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators.compare import REPORT, Comparison, ReportedField, RunInfo, compare


def report(spark, source, target, schema, keys=(), **more):
    fields = tuple(ReportedField(f.name, f.name, f.name, "sum") for f in T._parse_datatype_string(schema).fields if f.name not in keys)
    s, t = spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)
    return compare(s, t, Comparison(fields, tuple(keys), "Column", "src", "trg", **more))


#: (source, target, threshold, difference, pct_difference, status)
NUMBERS = [
    (1, 2, 0, 1.0, 100.0, "fail"),
    (8, 9, 30, 1.0, 12.5, "success"),
    (-1, 1, 0, 2.0, -200.0, "fail"),
    (2, 1, 7, -1.0, -50.0, "fail"),
    (4, 3, 7, -1.0, -25.0, "fail"),
    (8, 7, 7, -1.0, -12.5, "fail"),
    (16, 17, 7, 1.0, 6.25, "success"),
    (1, 3, 100, 2.0, 200.0, "fail"),
    (2, 4, 100, 2.0, 100.0, "success"),
    (4, 3, 25, -1.0, -25.0, "success"),
    (8093, None, 0, None, None, "fail"),
    (None, 8093, 0, None, None, "fail"),
    (None, None, 0, None, None, "success"),
    (0, 2, 0, 2.0, 100.0, "fail"),
    (2, 0, 0, -2.0, -100.0, "fail"),
    (0, 0, 0, 0.0, 0.0, "success"),
    (2, 5, 150, 3.0, 150.0, "success"),
]


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(10,2)", "int"])
def test_numbers(spark, kind):
    convert = {"double": float, "decimal(10,2)": __import__("decimal").Decimal}.get(kind, int)
    typed = lambda x: None if x is None else convert(x)
    for threshold in {n[2] for n in NUMBERS}:
        cases = [n for n in NUMBERS if n[2] == threshold]
        rows = [(i, typed(n[0])) for i, n in enumerate(cases)], [(i, typed(n[1])) for i, n in enumerate(cases)]
        for exact in (False, True):
            got = {int(r["group_by_columns"].split('"')[3]): r for r in report(spark, *rows, f"k int, x {kind}", ["k"], threshold=float(threshold), exact=exact).collect()}
            for i, (*_, difference, pct, status) in enumerate(cases):
                assert (got[i]["difference"], got[i]["pct_difference"], got[i]["validation_status"]) == (difference, pct, status), cases[i]
                assert got[i]["pct_threshold"] == threshold


def test_times_compare_in_whole_seconds(spark):
    a, b = datetime(2020, 9, 13, 12, 26, 40), datetime(2033, 5, 18, 3, 33, 20)
    for kind in ("timestamp", "timestamp_ntz"):
        got = report(spark, [(a, a.replace(microsecond=5))], [(b, a.replace(microsecond=900))], f"x {kind}, y {kind}").orderBy("validation_name").collect()
        assert (got[0]["difference"], got[0]["pct_difference"], got[0]["validation_status"]) == (400000000.0, 25.0, "fail")
        assert (got[1]["difference"], got[1]["pct_difference"], got[1]["validation_status"]) == (0.0, 0.0, "success")


def test_texts_and_values_compare_by_equality(spark):
    rows = [("a", "a"), ("b", None), (None, "b"), (None, None), ("c", "d")]
    source, target = [(i, a) for i, (a, _) in enumerate(rows)], [(i, b) for i, (_, b) in enumerate(rows)]
    got = report(spark, source, target, "k int, x string", ["k"], threshold=1000.0).orderBy("group_by_columns").collect()
    assert [r["validation_status"] for r in got] == ["success", "fail", "fail", "success", "fail"]
    assert all(r["difference"] is None and r["pct_difference"] is None for r in got)
    got = report(spark, [(1, 10)], [(1, 11)], "k int, x int", ["k"], values=True, threshold=1000.0).first()
    assert (got["difference"], got["validation_status"]) == (None, "fail")  # a threshold has no effect on values


def test_booleans_on_one_side(spark):
    s, t = spark.createDataFrame([(True,)], "x boolean"), spark.createDataFrame([(1,)], "x int")
    assert compare(s, t, Comparison((ReportedField("x"),), values=True)).first()["validation_status"] == "success"


def test_nan_is_null(spark):
    nan = math.nan
    for s, t, status in ((nan, nan, "success"), (nan, None, "success"), (nan, 1.0, "fail"), (1.0, nan, "fail")):
        assert report(spark, [(s,)], [(t,)], "x double").first()["validation_status"] == status


def test_rounding_hides_differences_only_by_default(spark):
    rows = [(1233170551.74,)], [(1233170552.74,)]
    assert report(spark, *rows, "x double").first()["validation_status"] == "success"
    got = report(spark, *rows, "x double", exact=True).first()
    assert (got["difference"], got["validation_status"]) == (1.0, "fail")


def test_large_integers_do_not_overflow(spark):
    got = report(spark, [(-(2**63),)], [(2**63 - 1,)], "x bigint").first()
    assert got["difference"] == float(2**64) and got["validation_status"] == "fail"


def test_keys_on_one_side_only(spark):
    got = report(spark, [("a", 2), ("b", 4)], [("b", 4), ("c", 1)], "g string, x int", ["g"], threshold=25.0).orderBy("group_by_columns").collect()
    assert [r["group_by_columns"] for r in got] == ['{"g": "a"}', '{"g": "b"}', '{"g": "c"}']
    assert [(r["source_agg_value"], r["target_agg_value"], r["validation_status"], r["pct_threshold"]) for r in got] == [("2", None, "fail", None), ("4", "4", "success", 25.0), (None, "1", "fail", None)]
    assert [(r["source_table_name"], r["target_table_name"], r["source_column_name"], r["target_column_name"]) for r in got][2] == ("src", "trg", None, "x")


def test_null_and_special_keys(spark):
    rows = [(None, 1, 1), ('"', 2, 1), ("\\", 3, 1), ("null", 4, 1)]
    got = report(spark, rows, rows, "g string, h int, x int", ["g", "h"]).collect()
    assert sorted(r["group_by_columns"] for r in got) == sorted(['{"g": "null", "h": "1"}', '{"g": "\\"", "h": "2"}', '{"g": "\\\\", "h": "3"}', '{"g": "null", "h": "4"}'])
    assert all(r["validation_status"] == "success" for r in got)


def test_repeated_keys_are_compared_pairwise(spark):
    assert report(spark, [(1, 1), (1, 2)], [(1, 1), (1, 2)], "k int, x int", ["k"]).count() == 4


def test_row_mismatches(spark):
    source, target = [(i, "c", "2") for i in range(100)], [(200, "c", "2")]
    got = report(spark, source, target, "id int, a string, b string", ["id"], values=True)
    assert got.count() == got.where("validation_status = 'fail'").count() == 202


def test_fields_without_metadata_and_hashes_as_keys(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, x int, y int")
    assert [r["validation_name"] for r in compare(df, df, Comparison((ReportedField("x"),), ("k",))).collect()] == ["x"]
    hashed = df.withColumnRenamed("k", "hash__all")
    fields = (ReportedField("hash__all"), ReportedField("x"))
    assert sorted(r["validation_name"] for r in compare(hashed, hashed, Comparison(fields, ("hash__all",))).collect()) == ["hash__all", "x"]


def test_columns_must_agree(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 2)], "y int, x int")
    with pytest.raises(ValueError):
        compare(a, b, Comparison((ReportedField("x"),)))


def test_report_columns_and_stamps(spark):
    df = spark.createDataFrame([(1, bytes([255]))], "x int, b binary")
    run = RunInfo((("team", "x"), ("env", "y")))
    out = compare(df, df, Comparison((ReportedField("x", "c", "d", "max"), ReportedField("b")), (), "Custom-query", None, None, named=False, primary_keys=("k1", "k2"), num_random_rows=7), run)
    assert tuple(out.columns) == REPORT
    r = out.where("validation_name = 'x'").first()
    assert (r["validation_type"], r["aggregation_type"], r["source_column_name"], r["target_column_name"]) == ("Custom-query", "max", "c", "d")
    assert (r["primary_keys"], r["num_random_rows"], r["group_by_columns"], r["source_table_name"]) == ("{k1, k2}", 7, None, None)
    assert r["run_id"] == run.run_id and [tuple(x) for x in r["labels"]] == list(run.labels) and r["start_time"] <= r["end_time"]
    assert out.where("validation_name = 'b'").first()["source_agg_value"] == "ff"
    assert dict(out.dtypes)["labels"] == "array<struct<key:string,value:string>>" and dict(out.dtypes)["num_random_rows"] == "bigint"


def test_one_join_without_nested_loops_or_python(spark):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("x"))
    out = compare(df, df, Comparison((ReportedField("x"),), ("id",)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and plan.count("FullOuter") >= 1

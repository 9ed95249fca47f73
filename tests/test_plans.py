import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.plans import expand
from concord.plans.frames import SOURCE, TARGET, filtered, side_frame
from concord.plans.spec import AggregateField, CalculatedField, FieldPair, Filter, ValidationSpec, clean_query, dump_specs, format_document, load_specs, parse_document

COLUMNS = {"Id": T.IntegerType(), "name": T.StringType(), "amount": T.DecimalType(10, 2), "big": T.DecimalType(30, 2), "born": T.DateType(), "seen": T.TimestampType(), "data": T.BinaryType(), "ok": T.BooleanType(), "tags": T.ArrayType(T.StringType())}
SCHEMA = T.StructType([T.StructField(n, k) for n, k in COLUMNS.items()])


def aliases(kind, columns, **options):
    fields, aggregates = expand.expand_aggregates(kind, columns, SCHEMA, SCHEMA, **options)
    return [f.alias for f in fields], [a.alias for a in aggregates]


def test_wildcards_take_numbers_and_more_on_request():
    assert aliases("sum", "*") == ([], ["sum__id", "sum__amount", "sum__big"])
    assert aliases("min", "*", string_lengths=True, timestamps=True) == (["length__name"], ["min__id", "min__length__name", "min__amount", "min__big", "min__born", "min__seen"])
    assert aliases("count", "*")[1] == ["count__id", "count__length__name", "count__amount", "count__big", "count__born", "count__seen", "count__data", "count__ok"]


def test_named_columns_of_all_kinds():
    assert aliases("sum", "ID,Name,born,seen,data") == (["length__name", "epoch_seconds__born", "epoch_seconds__seen", "byte_length__data"], ["sum__id", "sum__length__name", "sum__epoch_seconds__born", "sum__epoch_seconds__seen", "sum__byte_length__data"])
    assert aliases("max", ["born"]) == ([], ["max__born"])
    assert aliases("sum", ["id"], bigint=True) == (["cast_int64__Id"], ["sum__cast_int64__Id"])
    assert aliases("sum", ["id", "amount"], exclude=True) == (["length__name", "epoch_seconds__born", "epoch_seconds__seen", "byte_length__data"], ["sum__length__name", "sum__big", "sum__epoch_seconds__born", "sum__epoch_seconds__seen", "sum__byte_length__data"])
    assert aliases("sum", ["seen"], bigquery=True) == (["cast_timestamp__seen", "epoch_seconds__cast_timestamp__seen"], ["sum__epoch_seconds__cast_timestamp__seen"])
    with pytest.raises(ValueError):
        aliases("sum", "*", exclude=True)


def test_columns_that_the_target_lacks_are_passed_over():
    other = T.StructType([f for f in SCHEMA.fields if f.name != "amount"])
    assert [a.alias for a in expand.expand_aggregates("sum", "*", SCHEMA, other)[1]] == ["sum__id", "sum__big"]


def test_long_decimals_and_long_names():
    _, aggregates = expand.expand_aggregates("sum", ["big", "amount"], SCHEMA, SCHEMA)
    assert {a.alias: a.cast for a in aggregates} == {"sum__amount": None, "sum__big": "string"}
    long = T.StructType([T.StructField("x" * 140, T.IntegerType())])
    assert expand.expand_aggregates("sum", "*", long, long)[1][0].alias == "sum__dvt_calc_col_0"
    assert [k.cast for k in expand.key_pairs("id,big,data", SCHEMA, SCHEMA)] == [None, "string", "string"]
    with pytest.raises(ValueError):
        expand.key_pairs("none", SCHEMA, SCHEMA)


def test_row_pipeline_names_and_depths():
    fields, pairs = expand.row_pipeline("hash", "id,name", SCHEMA, SCHEMA, ignore_case=True)
    assert [(f.alias, f.depth) for f in fields if "name" in f.alias] == [("cast__name", 0), ("ifnull__cast__name", 1), ("rstrip__ifnull__cast__name", 2), ("upper__rstrip__ifnull__cast__name", 3)]
    assert [(f.alias, f.depth) for f in fields[-2:]] == [("concat__all", 4), ("hash__all", 5)] and pairs == (FieldPair("hash__all", "hash__all", "hash__all"),)
    fields, pairs = expand.row_pipeline("concat", "*", T.StructType(SCHEMA.fields[:-1]), T.StructType(SCHEMA.fields[:-1]))
    kinds = {f.alias: (f.kind, f.parameters) for f in fields}
    assert kinds["cast__ok"] == ("cast", {"default_cast": "bool_string"}) and kinds["cast__born"][1]["params"] == [{"format_str": "%Y-%m-%d"}] and pairs[0].alias == "concat__all"


def test_row_hash_of_dates_against_timestamps(spark):
    s, t = spark.sql("SELECT 1 AS id, DATE'2020-01-02' AS d, true AS b, CAST(NULL AS STRING) AS n"), spark.sql("SELECT 1 AS id, TIMESTAMP'2020-01-02 10:00:00' AS d, 1 AS b, 'DEFAULT_REPLACEMENT_STRING ' AS n")
    fields, pairs = expand.row_pipeline("hash", "d,b,n", s.schema, t.schema)
    spec = ValidationSpec("Row", calculated_fields=fields, comparison_fields=pairs, primary_keys=expand.key_pairs("id", s.schema, t.schema))
    assert side_frame(s, spec, SOURCE).first()["hash__all"] == side_frame(t, spec, TARGET).first()["hash__all"]


def test_comparison_fields():
    fields, pairs = expand.comparison_pairs("*", SCHEMA, SCHEMA, ["ID"], strip_texts=True)
    assert "id" not in [p.alias for p in pairs] and [f.alias for f in fields] == ["rstrip__name"] and {p.alias: p.cast for p in pairs}["ok"] == "bool"
    assert expand.column_chunks(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]] and expand.column_chunks(list("ab"), None) == [["a", "b"]]
    assert (expand.most_columns(None, "Postgres", "Oracle"), expand.most_columns(7, "Oracle", "x"), expand.most_columns(None, "x", "y")) == (99, 7, None)


FULL = {
    "type": "Row", "source_conn_name": "a", "target_conn_name": "b", "schema_name": "s", "table_name": "t", "target_table_name": "u",
    "aggregates": [{"field_alias": "n", "source_column": None, "target_column": None, "type": "count"}],
    "calculated_fields": [{"field_alias": "c", "source_calculated_columns": ["x"], "target_calculated_columns": ["y"], "type": "cast", "depth": 0, "default_cast": "string"}],
    "grouped_columns": [{"field_alias": "g", "source_column": "g", "target_column": "h", "cast": None}],
    "primary_keys": [{"field_alias": "k", "source_column": "k", "target_column": "k", "cast": None}],
    "comparison_fields": [{"field_alias": "c", "source_column": "c", "target_column": "c", "cast": None}],
    "filters": [{"type": "custom", "source": "x > 1", "target": "y > 1"}, {"type": "isin", "source_column": "x", "source_value": [1], "target_column": "y", "target_value": [1]}],
    "threshold": 1.5, "use_random_rows": True, "random_row_batch_size": 5, "labels": [["a", "b"]], "filter_status": ["fail"], "format": "csv", "unknown": 1,
}


def test_specifications_round_trip():
    spec = ValidationSpec.from_dict(FULL)
    assert spec.source_conn == "a" and spec.aggregates == (AggregateField("n", None, None, None, "count"),) and spec.calculated_fields[0] == CalculatedField("c", ("x",), ("y",), "cast", 0, {"default_cast": "string"})
    assert (spec.source_table, spec.target_table, spec.labels) == ("s.t", "s.u", (("a", "b"),))
    assert ValidationSpec.from_dict(json.loads(json.dumps(spec.to_dict()))) == spec
    for name in ("x.yaml", "x.json"):
        text = format_document(dump_specs([spec], "a", "b"), name)
        assert load_specs(parse_document(text, name)) == [spec]
    assert load_specs(FULL) == [spec]
    assert parse_document("labels:\n- !!python/tuple\n  - a\n  - b\n", "x.yaml") == {"labels": [["a", "b"]]} or parse_document("labels:\n- !!python/tuple\n  - a\n  - b\n", "x.yaml")


def test_bad_specifications():
    for bad in ({"type": "Other"}, {"type": "Row", "use_random_rows": True}, {"type": "Column", "filter_status": ["odd"]}, {"type": "Column", "filters": [{"type": "odd"}]}, {"type": "Custom-query", "source_query": " ; "}):
        with pytest.raises(ValueError):
            ValidationSpec.from_dict(bad)
    with pytest.raises(ValueError):
        format_document({}, "x.txt")
    assert clean_query(" SELECT 1;\n;\n") == "SELECT 1"
    inline = ValidationSpec.from_dict({"type": "Column", "source_conn": {"source_type": "Spark"}, "source_conn_name": "stored"})
    assert inline.source_conn == {"source_type": "Spark"}


def test_filters(spark):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("Rest"))
    f = lambda kind, column, a, b=None: Filter(kind, a, a if b is None else b, column, column)
    count = lambda *fs, side=SOURCE: filtered(df, fs, side).count()
    assert count(f("equals", "rest", 1)) == 7 and count(f("isin", "REST", [0, 1])) == 14 and count(f("greater_than", "id", 15), f("less_than", "id", 18)) == 2
    assert count(Filter("or", parts=(f("equals", "id", 1), f("equals", "id", 2)))) == 2
    assert count(Filter("custom", "id < 5", "id < 3")) == 5 and count(Filter("custom", "id < 5", "id < 3"), side=TARGET) == 3
    many = filtered(df, (f("isin", "id", list(range(2, 20_000))),), SOURCE)
    assert many.count() == 18 and many.columns == df.columns


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spec = ValidationSpec.from_dict({"type": "Column", "aggregates": [{"field_alias": "x", "source_column": "o_totalprice", "target_column": "o_totalprice", "type": "max"}], "filters": [{"type": "custom", "source": "o_orderkey < 100", "target": "TRUE"}]})
    plan = side_frame(df, spec, SOURCE)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderkey,100)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_nested_columns_are_refused(spark):
    df = spark.createDataFrame([([1],)], "x array<int>")
    spec = ValidationSpec.from_dict({"type": "Column", "aggregates": [{"field_alias": "x", "source_column": "x", "target_column": "x", "type": "count"}]})
    with pytest.raises(ValueError, match="nested"):
        side_frame(df, spec, SOURCE)
    with pytest.raises(ValueError, match="no column"):
        filtered(df, (Filter("equals", 1, 1, "y", "y"),), SOURCE)

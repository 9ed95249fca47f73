from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from concord.operators.match import closest, expand_schemas, match_tables
from concord.operators.partition import boundaries, literal, partition_documents, partition_filters, range_number, range_predicates
from concord.operators.sampling import sample_keys
from concord.operators.schemas import SchemaError, allow_list_text, match_schemas, parse_allow_list, validate_schemas
from concord.operators.validate import validate
from concord.plans.spec import ValidationSpec, load_specs


def pair(c):
    return {"field_alias": c, "source_column": c, "target_column": c}


# Schemas


def test_schema_matching():
    source = {"Id": "int64", "name": "string", "price": "decimal(5, 2)", "gone": "date", "skip": "int8"}
    target = {"ID": "int64", "name": "!string", "price": "decimal(10, 2)", "new": "date", "SKIP": "int64"}
    assert match_schemas(source, target, ["skip"]) == [
        ("id", "id", "int64", "int64", "success"), ("name", "name", "string", "!string", "fail"), ("price", "price", "decimal(5,2)", "decimal(10, 2)", "success"),
        ("gone", "N/A", "date", "N/A", "fail"), ("N/A", "new", "N/A", "date", "fail"),
    ]


@pytest.mark.parametrize(
    "source, target, status",
    [
        ("decimal(10, 2)", "decimal(5, 2)", "fail"), ("decimal(10, 2)", "decimal(12, 1)", "fail"), ("decimal(10, 2)", "decimal(12, 3)", "success"), ("!decimal(5, 0)", "decimal(10, 0)", "success"),
        ("int8", "int16", "fail"), ("int64", "int32", "fail"), ("!string", "string", "fail"), ("timestamp('UTC')", "decimal(5, 0)", "fail"), ("decimal(5, 0)", "int64", "fail"),
    ],
)
def test_types_that_differ(source, target, status):
    assert match_schemas({"x": source}, {"x": target})[0][-1] == status


def test_allow_lists():
    assert parse_allow_list("decimal(1-3,0):int64,string : date") == {"decimal(1,0)": ["int64"], "decimal(2,0)": ["int64"], "decimal(3,0)": ["int64"], "string": ["date"]}
    assert parse_allow_list("!string:string,decimal(2,1-2):decimal(5)") == {"!string": ["string"], "decimal(2,1)": ["decimal(5)"], "decimal(2,2)": ["decimal(5)"]}
    assert parse_allow_list("timestamp('UTC'):timestamp") == {"timestamp('UTC')": ["timestamp"]} and parse_allow_list("") == {}
    assert match_schemas({"x": "decimal(4, 0)"}, {"x": "int64"}, allow_list="decimal(1-18,0):int64")[0][-1] == "success"
    for bad in ("decimal(5-2,0):int64", "decimal(3-3,0):int64"):
        with pytest.raises(SchemaError):
            parse_allow_list(bad)
    assert allow_list_text("a:b", {"decimal(5,2)": "float64", "c": ["d", "e"]}) == "a:b,decimal(5,2):float64,c:d,c:e"


def test_schema_report(spark):
    a, b = spark.range(1).schema, spark.createDataFrame([], "id string").schema
    out = validate_schemas(spark, a, b, "s", "t")
    assert len(out.columns) == 19 and "pct_difference" not in out.columns
    assert out.first()[:9] == ("Schema", "Schema", "Schema", "s", "id", "!int64", "t", "id", "string")


# Partitions


@pytest.mark.parametrize("n, parts", [(32, 9), (10, 3), (7, 7), (5, 9), (100, 1), (50, 7)])
def test_boundaries_cut_even_ranges(spark, n, parts):
    df = spark.range(n).select((F.col("id") * 3).alias("k")).repartition(4)
    first = [r[0] for r in boundaries(df, ["K"], parts)]
    p = min(parts, n)
    assert len(first) == p and first == [3 * (-(-i * n // p) if i * n % p else i * n // p) for i in range(p)] or first == sorted(first)
    want = [next(r for r in range(1, n + 1) if -(-r * p // n) == b) for b in range(1, p + 1)]
    assert first == [3 * (r - 1) for r in want]
    counts = [r[0] for r in df.groupBy(range_number(df, ["k"], [(x,) for x in first]).alias("p")).count().orderBy("p").select("count").collect()]
    assert sum(counts) == n and max(counts) - min(counts) <= 1


KEYS = [("É'x\\", date(2020, 1, 2), i) for i in range(5)] + [("a", date(2021, 1, 1), i) for i in range(6)] + [("b", None, 1), (None, date(2020, 1, 1), 2)]


def test_predicates_of_several_keys_cover_all_rows_once(spark):
    df = spark.createDataFrame(KEYS, "a string, d date, i int")
    keys = ["a", "d", "i"]
    predicates = range_predicates(keys, boundaries(df, keys, 4))
    assert len(predicates) == 4 and "DATE '2021-01-01'" in " ".join(predicates)
    whole = [r for r in KEYS if None not in r]
    found = [tuple(r) for p in predicates for r in df.where(p).collect()]
    assert sorted(r for r in found if None not in r) == sorted(whole)
    assert all(found.count(r) <= 1 for r in KEYS)  # a null key is in no range, unless a key before it decides
    plan = df.where(predicates[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan
    assert range_predicates(["k"], [(1,)]) == ["TRUE"] == range_predicates(["k"], [])


def test_literals():
    assert [literal(x) for x in (None, True, 1, 1.5, "a'b", datetime(2020, 1, 2, 3, 4, 5), date(2020, 1, 2), b"\x0f")] == ["NULL", "TRUE", "1", "1.5", "'a''b'", "TIMESTAMP '2020-01-02 03:04:05'", "DATE '2020-01-02'", "X'0F'"]


def test_partition_files(spark):
    df = spark.range(90).selectExpr("id", "id % 7 AS x")
    spec = ValidationSpec.from_dict({"type": "Row", "table_name": "t", "primary_keys": [pair("id")], "comparison_fields": [pair("x")], "filters": [{"type": "custom", "source": "id >= 0", "target": "id >= 0"}]})
    filters = partition_filters(df, df.withColumnRenamed("id", "ID"), spec, 9)
    documents = partition_documents(spec, filters, 5, "a", "b")
    assert list(documents) == ["0000.yaml", "0001.yaml"] and [len(d["validations"]) for d in documents.values()] == [5, 4]
    specs = [s for d in documents.values() for s in load_specs(d)]
    assert all(len(s.filters) == 2 for s in specs) and sum(validate(df, df, s).count() for s in specs) == 90
    with pytest.raises(ValueError):
        partition_documents(spec, filters * 2000, 1)


def test_partition_plan_has_no_single_task_window(spark):
    df = spark.range(1000).toDF("id")
    assert len(boundaries(df, ["id"], 10)) == 10
    assert "Window" not in df.orderBy("id")._jdf.queryExecution().executedPlan().toString()


# Tables


def test_matching_tables():
    assert closest("orders", ["order", "orders"], 1) == "orders" and closest("orders", ["parts"], 0.9) is None and closest("ab", ["ab", "ab"]) == "ab"
    assert match_tables([("s", "orders"), (None, "x")], [("s", "orders"), ("s", "order")]) == [{"schema_name": "s", "table_name": "orders", "target_schema_name": "s", "target_table_name": "orders"}]
    source, target = (lambda schemas: [("s", "a"), ("s", "b")]), (lambda: [("s", "b"), ("t", "a")])
    assert expand_schemas([{"schema_name": "s", "table_name": "*"}, {"schema_name": "q", "table_name": "z"}], source, target) == [{"schema_name": "s", "table_name": "b", "target_schema_name": "s", "target_table_name": "b"}, {"schema_name": "q", "table_name": "z"}]
    kept = [{"schema_name": "s", "table_name": "*", "target_table_name": "x"}]
    assert expand_schemas(kept, source, target) == kept


# Validations


def test_self_validation_never_fails(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for config in (
        {"type": "Column", "aggregates": [pair("o_totalprice") | {"type": k, "field_alias": k} for k in ("sum", "avg", "min", "max", "std")], "grouped_columns": [pair("o_orderstatus")]},
        {"type": "Row", "primary_keys": [pair("o_orderkey")], "comparison_fields": [pair(c) for c in df.columns if c != "o_orderkey"]},
        {"type": "Schema"},
    ):
        out = validate(df, df, ValidationSpec.from_dict(config))
        assert out.count() > 0 and out.where("validation_status = 'fail'").count() == 0


def test_random_rows(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id"), F.lit("  ")).alias("k"), "id")
    other = df.select(F.rtrim("k").alias("k"), "id")
    config = {"type": "Row", "primary_keys": [pair("k")], "comparison_fields": [pair("id")], "use_random_rows": True, "random_row_batch_size": 10}
    out = validate(df, df, ValidationSpec.from_dict(config)).collect()
    assert len(out) == 10 and all(r["num_random_rows"] == 10 and r["validation_status"] == "success" for r in out)
    trimmed = validate(df, other, ValidationSpec.from_dict(config | {"trim_string_pks": True})).collect()
    assert len(trimmed) == 10 and all(r["validation_status"] == "success" for r in trimmed)
    binary = df.select(F.encode("k", "UTF-8").alias("k"), "id")
    text = {"primary_keys": [pair("k") | {"cast": "string"}]}
    assert len(validate(binary, binary, ValidationSpec.from_dict(config | text)).collect()) == 10
    assert validate(df.limit(0), other.limit(3), ValidationSpec.from_dict(config)).count() == 3  # an empty sample restricts nothing
    assert "TakeOrderedAndProject" in sample_keys(df, ["k"], 5)._jdf.queryExecution().executedPlan().toString()


def test_drill_down(spark):
    rows = [(i, i % 3, i % 2, i) for i in range(60)]
    changed = [r for r in rows if r[0] != 4] + [(1004, 2, 1, 7)]
    schema = "id int, a int, b int, x int"
    s, t = spark.createDataFrame(rows, schema), spark.createDataFrame(changed, schema)
    config = {"type": "Row", "primary_keys": [pair("id")], "comparison_fields": [pair("x")], "grouped_columns": [pair("a"), pair("b")], "aggregates": [{"field_alias": "n", "source_column": None, "target_column": None, "type": "count"}]}
    out = validate(s, t, ValidationSpec.from_dict(config))
    groups = {r["group_by_columns"]: r["validation_status"] for r in out.where("validation_name = 'n'").collect()}
    assert groups == {'{"a": "0"}': "success", '{"a": "1", "b": "1"}': "success", '{"a": "2", "b": "0"}': "success"}
    fails = {r["group_by_columns"] for r in out.where("validation_name = 'x' AND validation_status = 'fail'").collect()}
    assert fails == {'{"id": "4"}', '{"id": "1004"}'} and out.where("validation_name = 'x'").count() == 10 + 11
    large = validate(s, t, ValidationSpec.from_dict(config | {"max_recursive_query_size": 10}))
    assert {r["group_by_columns"] for r in large.where("validation_name = 'n' AND validation_status = 'fail'").collect()} == {'{"a": "2", "b": "1"}'}
    with pytest.raises(ValueError):
        validate(s, t, ValidationSpec.from_dict(config | {"primary_keys": []}))


def test_rows_need_keys(spark):
    df = spark.range(1).toDF("id")
    with pytest.raises(ValueError):
        validate(df, df, ValidationSpec.from_dict({"type": "Row", "comparison_fields": [pair("id")]}))


def test_drill_down_through_three_groups_with_null_keys(spark, tmp_path):
    """A null key and the text "null" are two groups; each level reads either side once."""
    rows = [(i, None if i % 5 == 0 else "null" if i % 5 == 1 else "x", i % 3, None if i % 4 == 0 else i % 2, i) for i in range(120)]
    changed = [r for r in rows if r[0] not in (10, 33)]
    schema = "id int, a string, b int, c int, x int"
    s, t = (spark.createDataFrame(r, schema) for r in (rows, changed))
    s.write.parquet(str(tmp_path / "s"))
    t.write.parquet(str(tmp_path / "t"))
    s, t = (spark.read.parquet(str(tmp_path / n)) for n in "st")
    config = {"type": "Row", "primary_keys": [pair("id")], "comparison_fields": [pair("x")], "grouped_columns": [pair("a"), pair("b"), pair("c")], "aggregates": [{"field_alias": "n", "source_column": None, "target_column": None, "type": "count"}]}
    out = validate(s, t, ValidationSpec.from_dict(config))
    found = out.collect()
    assert {r["group_by_columns"] for r in found if r["validation_name"] == "x" and r["validation_status"] == "fail"} == {'{"id": "10"}', '{"id": "33"}'}
    bad = {tuple(rows[i][1:4]) for i in (10, 33)}
    assert sum(r["validation_name"] == "x" for r in found) == sum(tuple(r[1:4]) in bad for r in rows)
    level = lambda n: {tuple(r[1 : 1 + n]) for r in rows}
    ended = sum(sum(g[:n] not in {x[:n] for x in bad} and g[: n - 1] in {x[: n - 1] for x in bad} for g in level(n)) for n in (1, 2, 3))
    assert sum(r["validation_name"] == "n" for r in found) == ended
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2


def test_sides_without_keys_have_one_row(spark):
    from concord.operators.compare import Comparison, ReportedField, compare

    c = Comparison((ReportedField("x", "x", "x"),))
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,), (1,)], "x int")
    assert [r["validation_status"] for r in compare(one, one, c).collect()] == ["success"]
    assert [r["validation_status"] for r in compare(one, one.limit(0), c).collect()] == ["fail"]
    for a, b in ((one, two), (two, one)):
        with pytest.raises(Exception, match="one row at most"):
            compare(a, b, c).collect()


def test_ranges_of_many_boundaries(spark):
    df = spark.range(0, 4000).selectExpr("CAST(id AS INT) AS a", "CAST(id % 3 AS STRING) AS b", "DATE '2020-01-01' + CAST(id AS INT) AS d")
    for keys in (["a"], ["d", "a"], ["b", "a"]):
        for parts in (1, 2, 3, 700):
            firsts = boundaries(df, keys, parts)
            got = df.groupBy(range_number(df, keys, firsts).alias("n")).count().collect()
            assert sorted(r["n"] for r in got) == list(range(parts)) and max(r["count"] for r in got) - min(r["count"] for r in got) <= 1
    assert df.select(range_number(df.withColumn("a", F.lit(None).cast("int")), ["a"], [(1,), (5,)])).first()[0] is not None

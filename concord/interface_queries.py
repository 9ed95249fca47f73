"""Queries of the driver contract for interfaces: connections, catalogs, arguments, documents, reports and the service.

They are added to those of ``queries``; sides and SQL are as there.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord import arguments
from concord.functions.types import schema_names
from concord.operators.compare import Comparison, ReportedField, compare
from concord.operators.match import expand_schemas
from concord.operators.partition import partition_documents, partition_filters
from concord.operators.sampling import in_sample, sample_keys
from concord.operators.schemas import allow_list_text
from concord.operators.validate import validate
from concord.plans import expand
from concord.plans.frames import SOURCE, TARGET, filtered, prepared
from concord.plans.spec import ValidationSpec, format_document, load_specs, parse_document
from concord.queries import A_B, EXACT, G, G_SQL, KEY, R_MORE, SHOWN, TABLES, agg, both, changed_orders, orders_sql, pair, register, report_sql, schema_sql, shown, table
from concord.runner import Runner
from concord.service import answer
from concord.sources.connections import Connection, ConnectionStore, config_from_options, connect
from concord.sources.reports import TableSink, formatted, sink


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of the warehouse."""
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/concord-{name}-{uuid4().hex}"
    return root if "://" in root or not root.startswith("file:") else f"file://{root.removeprefix('file:')}"


def values(*rows: tuple) -> str:
    """SQL of literal rows of text, numbers, booleans and nulls."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join(f"({', '.join(map(one, r))})" for r in rows)


# Connections and catalogs -------------------------------------------------------------------------


def external(spark: SparkSession, sf_dir: str, name: str, stored: str) -> None:
    spark.sql(f"CREATE TABLE {stored} USING parquet OPTIONS (path '{sf_dir}/{name}.parquet')")


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of Spark's catalog through a connection."""
    name = f"concord_orders_{uuid4().hex}"
    external(spark, sf_dir, "orders", name)
    return connect(spark, {"source_type": "Spark"}).table("default", name)


register("scan_table", table_scan, "SELECT * FROM orders")

QUERY_COLUMNS = "o_orderkey, o_orderstatus AS status, o_totalprice * 2 AS twice, o_orderdate, CAST(o_orderdate AS DATE) AS day, o_orderkey > 5 AS late, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders"


def query_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of a query's result, which isn't run."""
    c = connect(spark, {"source_type": "FileSystem", "table_name": "concord_orders_file", "file_path": f"{sf_dir}/orders.parquet", "file_type": "parquet"})
    found = schema_names(c.query_schema(f"SELECT {QUERY_COLUMNS.replace('FROM orders', 'FROM concord_orders_file')}"))
    return spark.createDataFrame([(n, k.lstrip("!")) for n, k in found.items()], "column_name string, type string")


register(
    "query_schema",
    query_schema,
    f"""SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float64' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DECIMAL(18,2)' THEN 'decimal(18, 2)'
        WHEN 'TIMESTAMP_NS' THEN 'timestamp' ELSE lower(column_type) END AS type FROM (DESCRIBE SELECT {QUERY_COLUMNS})""",
)


def with_catalog(use: Callable[[Connection, str], list[tuple]], schema: str) -> Callable[[SparkSession, str], DataFrame]:
    """Query of what is found in a schema of all tables, which is there meanwhile."""

    def run(spark, sf_dir):
        name = f"concord_{uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name}")
        try:
            for t in TABLES:
                external(spark, sf_dir, t, f"{name}.{t}")
            return spark.createDataFrame(use(connect(spark, {"source_type": "Spark"}), name), schema)
        finally:
            spark.sql(f"DROP DATABASE {name} CASCADE")

    return run


LISTED = "information_schema.tables WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
register("catalog_listing", with_catalog(lambda c, name: [(name in c.schemas(), t) for s, t in c.all_tables([name, "concord_no_such_schema"]) if s == name], "schema_listed boolean, table_name string"), f"SELECT TRUE AS schema_listed, table_name FROM {LISTED}")


def whole_schema(c: Connection, name: str) -> list[tuple]:
    wanted = [{"schema_name": name, "table_name": "*"}, {"schema_name": "s", "table_name": "t", "target_table_name": "u"}]
    found = expand_schemas(wanted, c.all_tables, lambda: c.all_tables([name]))
    return [(m["table_name"], m["target_table_name"]) for m in found]


register("schema_expansion", with_catalog(whole_schema, "table_name string, target_table_name string"), f"SELECT table_name, table_name AS target_table_name FROM {LISTED} UNION ALL SELECT 't', 'u'")


def raw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an ad-hoc query, as its command prints them."""
    c = connect(spark, {"source_type": "FileSystem", "table_name": "concord_lines_file", "file_path": f"{sf_dir}/lineitem.parquet", "file_type": "parquet"})
    rows = c.rows("SELECT L_ReturnFlag, count(*) AS N, min(l_orderkey) AS First FROM concord_lines_file GROUP BY 1")
    return spark.createDataFrame(rows, "l_returnflag string, n long, first long")


register("raw_query", raw_query, "SELECT l_returnflag, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1")


def stored_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two tables, through connections that were stored from options and from raw JSON."""
    store = ConnectionStore(spark, folder(spark, "connections"))
    options = {"table_name": "nation", "file_path": f"{sf_dir}/nation.parquet", "file_type": "parquet"}
    store.create("by-options", config_from_options("FileSystem", options))
    store.create("by-json", config_from_options("Raw", {"json": json.dumps({"source_type": "FileSystem", "table_name": "region", "file_path": f"{sf_dir}/region.parquet", "file_type": "parquet"})}))
    runner = Runner(spark, store)
    nations, regions = (runner.connection(n).table(None, None) for n in reversed(store.names()))
    return nations.select(F.lit("nation").alias("of"), F.col("n_name").alias("name")).unionAll(regions.select(F.lit("region"), "r_name"))


register("connection_store", stored_connection, "SELECT 'nation' AS of, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")

# Arguments and plans -------------------------------------------------------------------------------

#: A filter for either side; the first colon is in quotes.
BY_TEXT = "o_orderstatus <> ':' AND o_totalprice > 1000:o_orderstatus = 'F'"


def filter_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, orders = tuple(arguments.filters(BY_TEXT)), table(spark, sf_dir, "orders")
    a, b = (filtered(orders, parsed, side).select(F.lit(side).alias("side"), "o_orderkey") for side in (SOURCE, TARGET))
    return a.unionAll(b)


register("filter_argument", filter_argument, "SELECT 'source' AS side, o_orderkey FROM orders WHERE o_orderstatus <> ':' AND o_totalprice > 1000 UNION ALL SELECT 'target', o_orderkey FROM orders WHERE o_orderstatus = 'F'")


def table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables named on the command line, as text and as JSON."""
    found = arguments.table_mappings('shop.orders=old.orders,shop."odd.name",shop.part=parts') + arguments.table_mappings('[{"schema_name": "a", "table_name": "b"}]')
    names = ("schema_name", "table_name", "target_schema_name", "target_table_name")
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in found], ", ".join(f"{n} string" for n in names))


MAPPED = values(("shop", "orders", "old", "orders"), ("shop", "odd.name", None, None), ("shop", "part", None, "parts"), ("a", "b", None, None))
register("table_argument", table_argument, f"SELECT * FROM ({MAPPED}) AS v(schema_name, table_name, target_schema_name, target_table_name)")


def excluded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all columns but those listed, in whatever case."""
    s, t = both(spark, sf_dir)
    fields, aggregates = expand.column_validation(s.schema, t.schema, {"count": ["O_TOTALPRICE", "o_orderdate", "o_orderkey"]}, exclude=True)
    return shown(validate(s, t, ValidationSpec("Column", table_name="orders", target_table_name="changed", calculated_fields=fields, aggregates=aggregates)))


LEFT = ("o_custkey", "length__o_orderstatus", "length__o_orderpriority")  # texts are counted by their lengths
register("excluded_columns", excluded_columns, orders_sql("count(*) AS count, " + ", ".join(f"count({c.removeprefix('length__')}) AS count__{c}" for c in LEFT), [("count", "count", None, "int"), *((f"count__{c}", "count", c, "int") for c in LEFT)]))

#: A column whose calculated fields would have names of over 128 characters.
LONG = "k" * 126


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of rows with a long column name, which the calculated fields' names don't hold."""
    s, t = (x.select("o_orderkey", F.col("o_orderpriority").alias(LONG)) for x in both(spark, sf_dir))
    fields, pairs = expand.row_pipeline("concat", "*", s.schema, t.schema)
    if any(len(f.alias) > 128 for f in fields):
        raise ValueError("an alias is too long")
    spec = ValidationSpec("Row", table_name="orders", target_table_name="changed", primary_keys=expand.key_pairs("o_orderkey", s.schema, t.schema), calculated_fields=fields, comparison_fields=pairs)
    names = [f.alias for f in fields if LONG in f.source]
    return shown(validate(s, t, spec)).withColumn("alias", F.lit(",".join(names)))


CONCAT = "o_orderkey, CAST(o_orderkey AS VARCHAR) || coalesce(rtrim(o_orderpriority), 'DEFAULT_REPLACEMENT_STRING') AS concat__all"
register("long_names", long_names, f"SELECT *, 'cast__dvt_calc_col_1' AS alias FROM ({orders_sql(CONCAT, [('concat__all', None, 'concat__all', 'value')], **R_MORE)})")


def all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the key, value by value, texts without trailing blanks."""
    s, t = (x.drop("o_totalprice") for x in both(spark, sf_dir))
    s = s.withColumn("o_orderpriority", F.concat("o_orderpriority", F.lit("  ")))
    fields, pairs = expand.comparison_pairs("*", s.schema, t.schema, keys=["O_ORDERKEY"], strip_texts=True)
    return shown(validate(s, t, ValidationSpec("Row", table_name="orders", target_table_name="changed", primary_keys=expand.key_pairs("o_orderkey", s.schema, t.schema), calculated_fields=fields, comparison_fields=pairs)))


ALL = ("o_custkey", "rstrip__o_orderstatus", "o_orderdate", "rstrip__o_orderpriority")
register("comparison_all_columns", all_columns, orders_sql("o_orderkey, " + ", ".join(f"{c.removeprefix('rstrip__')} AS {c}" for c in ALL), [(c, None, c, "value") for c in ALL], **R_MORE))

# Reports --------------------------------------------------------------------------------------------
GROUPED = ValidationSpec.from_dict({"type": "Column"} | EXACT | G)


def grouped(spark: SparkSession, sf_dir: str, spec: ValidationSpec = GROUPED) -> DataFrame:
    return validate(*both(spark, sf_dir), spec)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with the labels, threshold and times of its run."""
    spec = ValidationSpec.from_dict({"type": "Column"} | EXACT | G | {"labels": arguments.labels("team=a b,stage=x"), "threshold": arguments.threshold("1")})
    report = grouped(spark, sf_dir, spec)
    texts = F.concat_ws(",", F.transform("labels", lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return report.select(*SHOWN, texts.alias("labels"), (F.col("start_time") <= F.col("end_time")).alias("timed"), (F.length("run_id") > 0).alias("identified"))


register("labels_and_times", labelled, f"SELECT *, 'team=a b,stage=x' AS labels, TRUE AS timed, TRUE AS identified FROM ({G_SQL})")


def known_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without a reported field are passed over."""
    s, t = (x.select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority") for x in both(spark, sf_dir))
    return shown(compare(s, t, Comparison((ReportedField("o_orderpriority", "o_orderpriority", "o_orderpriority"),), ("o_orderkey",), "Row", "a", "b", values=True, primary_keys=("o_orderkey",))))


register("known_fields", known_fields, orders_sql("o_orderkey, o_orderstatus, o_custkey, o_orderpriority", [("o_orderpriority", None, "o_orderpriority", "value")], keys=("o_orderkey",), primary=("o_orderkey",), **A_B))


def refused_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sides whose columns differ by name or order are refused."""
    s = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c, out = Comparison((ReportedField("n_name", "n_name", "n_name"),), ("n_nationkey",), "Row", "a", "b", values=True), []
    for case, t in (("same", s), ("order", s.select("n_name", "n_nationkey")), ("name", s.toDF("n_nationkey", "N_NAME")), ("missing", s.select("n_nationkey"))):
        try:
            out.append((case, False, compare(s, t, c).count()))
        except ValueError:
            out.append((case, True, 0))
    return spark.createDataFrame(out, "case string, refused boolean, n long")


register("refused_columns", refused_columns, "SELECT 'same' AS \"case\", FALSE AS refused, count(*) AS n FROM nation UNION ALL " + values(("order", True, 0), ("name", True, 0), ("missing", True, 0)))


def hashed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are rows' hashes are reported like fields."""
    s = table(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("hash__all"), F.col("n_regionkey").alias("n"), "n_nationkey")
    t = s.where("n_nationkey <> 3").withColumn("n", F.col("n") + (F.col("n_nationkey") % 2))
    fields = tuple(ReportedField(c, c, c) for c in ("hash__all", "n"))
    return shown(compare(s.drop("n_nationkey"), t.drop("n_nationkey"), Comparison(fields, ("hash__all",), "Row", "a", "b", values=True, primary_keys=("hash__all",))))


register("hashed_keys", hashed_keys, report_sql("SELECT sha256(n_name) AS hash__all, n_regionkey AS n FROM nation", "SELECT sha256(n_name) AS hash__all, n_regionkey + n_nationkey % 2 AS n FROM nation WHERE n_nationkey <> 3", [("hash__all", None, "hash__all", "value"), ("n", None, "n", "value")], keys=("hash__all",), primary=("hash__all",), **A_B))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report printed as JSON, read again."""
    report = grouped(spark, sf_dir)
    rows = json.loads(formatted(report, "json"))
    return spark.createDataFrame([tuple(r[c] for c in SHOWN) for r in rows.values()], report.select(*SHOWN).schema)


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report printed as CSV, read again, its text columns."""
    rows = csv.DictReader(io.StringIO(formatted(grouped(spark, sf_dir), "csv")))
    return spark.createDataFrame([tuple(r[c] for c in CSV_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in CSV_COLUMNS))


CSV_COLUMNS = ("validation_name", "source_agg_value", "target_agg_value", "group_by_columns", "validation_status")
register("report_json", report_json, G_SQL)
register("report_csv", report_csv, f"SELECT {', '.join(CSV_COLUMNS)} FROM ({G_SQL})")


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures appended twice to a table."""
    name = f"concord_report_{uuid4().hex}"
    for _ in range(2):
        TableSink(name, statuses=["fail"]).execute(grouped(spark, sf_dir))
    return shown(spark.table(name))


register("report_table", report_table, f"SELECT * FROM ({G_SQL}) WHERE validation_status = 'fail' UNION ALL SELECT * FROM ({G_SQL}) WHERE validation_status = 'fail'")


def report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that each printed form of column and schema reports shows."""
    orders, out = table(spark, sf_dir, "orders"), []
    for kind in ("Column", "Schema"):
        report = validate(orders, orders, ValidationSpec.from_dict({"type": kind, "aggregates": [agg("n", "count")]}))
        for form in ("text", "csv"):
            head = formatted(report, form, sink(None, form, None, kind).hidden).splitlines()[0]
            out += [(kind, form, c) for c in (head.split(",") if form == "csv" else head.split())]
    return spark.createDataFrame(out, "validation_type string, form string, shown string")


#: Columns of reports, those that column reports print, and those that schema reports print.
ALL_SHOWN = ("validation_name", "validation_type", "aggregation_type", "source_table_name", "source_column_name", "source_agg_value", "target_table_name", "target_column_name", "target_agg_value", "group_by_columns", "primary_keys", "num_random_rows", "difference", "pct_difference", "pct_threshold", "validation_status", "run_id", "labels", "start_time", "end_time")
PRINTED = ("validation_name", "validation_type", "source_table_name", "source_column_name", "source_agg_value", "target_agg_value", "pct_difference", "validation_status", "run_id")
PRINTED_OF_SCHEMAS = ("validation_name", "validation_type", "source_table_name", "source_column_name", "source_agg_value", "target_table_name", "target_column_name", "target_agg_value", "validation_status", "run_id", "labels")
FORMS = [("Column", "text", c) for c in PRINTED] + [("Column", "csv", c) for c in ALL_SHOWN] + [("Schema", "text", c) for c in PRINTED_OF_SCHEMAS] + [("Schema", "csv", c) for c in ALL_SHOWN if c != "pct_difference"]
register("report_columns", report_columns, f"SELECT * FROM ({values(*FORMS)}) AS v(validation_type, form, shown)")


def service_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service answers to a configuration."""
    root = folder(spark, "service")
    changed_orders(table(spark, sf_dir, "orders")).write.parquet(root)
    one = lambda path: {"source_type": "FileSystem", "table_name": "t", "file_path": path, "file_type": "parquet"}
    spec = ValidationSpec.from_dict({"type": "Column", "source_conn": one(f"{sf_dir}/orders.parquet"), "target_conn": one(root)} | EXACT | G)
    rows = answer(Runner(spark), {"config": spec.to_dict()})
    return spark.createDataFrame([tuple(r[c] for c in SHOWN) for r in rows], grouped(spark, sf_dir).select(*SHOWN).schema)


register("service_answer", service_answer, G_SQL)

# Samples, partitions, schemas ---------------------------------------------------------------------


def random_query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a custom query's rows: how many, and how many differ just where the target lacks them."""
    a, b = (x.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey") for x in both(spark, sf_dir))
    spec = ValidationSpec.from_dict({"type": "Custom-query", "custom_query_type": "row", "primary_keys": [pair("o_orderkey")], "comparison_fields": [pair("o_custkey")], "use_random_rows": True, "random_row_batch_size": 50})
    report = validate(a, b, spec, seed=2)
    key = F.regexp_extract("group_by_columns", "([0-9]+)", 1).cast("long")
    right = (F.col("validation_status") == "fail") == (key % 97 == 0)
    return report.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), F.sum("num_random_rows").alias("sizes"), F.sum(right.cast("int")).alias("as_expected"))


register("random_query_rows", random_query_rows, "SELECT least(count(*), 50) AS n, n AS keys, n * 50 AS sizes, n AS as_expected FROM orders WHERE o_orderstatus = 'F'")


def unsorted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that sorts nothing: how many rows, and that they are the table's."""
    lines = table(spark, sf_dir, "orders")
    keys = sample_keys(lines, ["O_ORDERKEY"], 200, order=False).toDF("key")
    return in_sample(lines, "o_orderkey", keys, 200).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))


register("unsorted_sample", unsorted_sample, "SELECT least(count(*), 200) AS n, n AS keys FROM orders")


def partition_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on either side of every validation in the documents that partitioning writes, three a file."""
    s, t = both(spark, sf_dir)
    spec = ValidationSpec.from_dict(KEY | {"comparison_fields": [pair("o_custkey")], "table_name": "orders"})
    documents = partition_documents(spec, partition_filters(s, t, spec, 7), 3, "a", "b")
    blocks = [(name, x) for name, d in documents.items() for x in load_specs(parse_document(format_document(d, name), name))]
    one = lambda i, name, x, df, side: prepared(df, x, side).agg(F.lit(name).alias("file"), F.lit(i).alias("part"), F.count(F.lit(1)).alias(f"{side}_rows"))
    a, b = (reduce(DataFrame.unionAll, [one(i, name, x, df, side) for i, (name, x) in enumerate(blocks)]) for df, side in ((s, SOURCE), (t, TARGET)))
    return a.join(b, ["file", "part"])


def partition_sql() -> str:
    from concord.queries import SQL

    return f"SELECT printf('%04d.yaml', part // 3) AS file, * FROM ({SQL['partition_counts']})"


register("partition_blocks", partition_blocks, partition_sql())

#: (column, source type, target type): nullable unless its text begins with "!".
CASES = (
    ("wider_integer", "byte", "short"), ("listed_integer", "short", "int"), ("in_range", "decimal(4,0)", "bigint"), ("out_of_range", "decimal(8,0)", "bigint"), ("required_decimal", "!decimal(5,0)", "decimal(10,0)"),
    ("required_text", "!string", "string"), ("both_required", "!string", "!string"), ("narrower", "decimal(10,2)", "decimal(5,2)"), ("by_document", "date", "timestamp_ntz"), ("unlisted", "timestamp_ntz", "date"),
)


def schema_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of an allow-list, lists by documents, integers' widths and required columns."""
    one = lambda i: spark.createDataFrame([], T.StructType([T.StructField(c[0], T._parse_datatype_string(c[i].lstrip("!")), not c[i].startswith("!")) for c in CASES]))
    allowed = allow_list_text("int16:int32,decimal(2-6,0):int64", {"date": ["timestamp"]})
    report = validate(one(1), one(2), ValidationSpec.from_dict({"type": "Schema", "table_name": "orders", "target_table_name": "changed", "allow_list": allowed}))
    return report.select(*[c for c in SHOWN if c != "pct_difference"])


FOUND = (
    ("wider_integer", "int8", "int16", "fail"), ("listed_integer", "int16", "int32", "success"), ("in_range", "decimal(4,0)", "int64", "success"), ("out_of_range", "decimal(8, 0)", "int64", "fail"),
    ("required_decimal", "!decimal(5,0)", "decimal(10, 0)", "success"), ("required_text", "!string", "string", "fail"), ("both_required", "!string", "!string", "success"),
    ("narrower", "decimal(10, 2)", "decimal(5, 2)", "fail"), ("by_document", "date", "timestamp", "success"), ("unlisted", "timestamp", "date", "fail"),
)
register("schema_cases", schema_cases, schema_sql([(c, c, s, t, status) for c, s, t, status in FOUND]))

"""Queries of the driver contract: one for each operator, over whole tables.

Source and target are a table and a changed copy of it (see ``changed_orders``).  The
reports leave out run ids and times.  Comparisons name their mode: EXACT compares
decimals as they are; the default rounds them as floats.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.types import schema_names
from concord.operators.compare import REPORT, Comparison, ReportedField, compare
from concord.operators.match import match_tables
from concord.operators.partition import boundaries, partition_filters, range_number
from concord.operators.sampling import in_sample
from concord.operators.validate import validate
from concord.plans import expand
from concord.plans.frames import SOURCE, filtered, prepared, side_frame
from concord.plans.spec import Filter, ValidationSpec, format_document, load_specs, parse_document
from concord.runner import Runner
from concord.sources.connections import Files, connect

SHOWN = REPORT[:16]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return connect(spark, {"source_type": "FileSystem", "table_name": name, "file_path": f"{sf_dir}/{name}.parquet", "file_type": "parquet"}).table(None, name)


def changed_orders(orders: DataFrame) -> DataFrame:
    """Orders with rows taken out, put in, and values changed and made null."""
    key = F.col("o_orderkey")
    changed = orders.where(key % 97 != 0).withColumns({"o_totalprice": F.when(key % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(key % 61 != 0, F.col("o_orderpriority"))})
    return changed.unionByName(orders.where(key % 101 == 0).withColumn("o_orderkey", key + 10000000))


CHANGED_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 101 = 0
"""


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    return orders, changed_orders(orders)


def shown(report: DataFrame) -> DataFrame:
    return report.select(*SHOWN)


def calc(alias: str, kind: str, *columns: str, depth: int = 0, **parameters) -> dict:
    return {"field_alias": alias, "source_calculated_columns": list(columns), "target_calculated_columns": list(columns), "type": kind, "depth": depth} | parameters


def agg(alias: str, kind: str, column: str | None = None, cast: str | None = None) -> dict:
    return {"field_alias": alias, "source_column": column, "target_column": column, "type": kind, "cast": cast}


def pair(column: str, alias: str | None = None, cast: str | None = None) -> dict:
    return {"field_alias": alias or column, "source_column": column, "target_column": column, "cast": cast}


PRICE = calc("price", "cast", "o_totalprice", default_cast="decimal(18,2)")
EXACT = {"exact": True, "table_name": "orders", "target_table_name": "changed"}


def orders_report(**config) -> Callable[[SparkSession, str], DataFrame]:
    """Query of a validation of orders and their changed copy."""
    spec = ValidationSpec.from_dict({"type": "Column"} | EXACT | config)
    return lambda spark, sf_dir: shown(validate(*both(spark, sf_dir), spec))


def calculated(name: str, keys: tuple[str, ...], *fields: dict) -> Callable[[SparkSession, str], DataFrame]:
    """Query of calculated fields of a table, with its keys; only the last field is shown."""
    spec = ValidationSpec.from_dict({"type": "Row", "calculated_fields": list(fields)})
    return lambda spark, sf_dir: prepared(table(spark, sf_dir, name), spec, SOURCE).select(*keys, F.col(fields[-1]["field_alias"]).alias("value"))


def filtered_orders(*filters: dict) -> Callable[[SparkSession, str], DataFrame]:
    parsed = tuple(Filter.from_dict(f) for f in filters)
    return lambda spark, sf_dir: filtered(table(spark, sf_dir, "orders"), parsed, SOURCE).select("o_orderkey", "o_orderstatus", "o_totalprice")


def by_value(column: str, kind: str, value, **more) -> dict:
    return {"type": kind, "source_column": column, "source_value": value, "target_column": column, "target_value": value} | more


# SQL of reports ---------------------------------------------------------------------------------


def report_sql(source: str, target: str, fields: list[tuple[str, str | None, str | None, str]], keys: tuple[str, ...] = (), kind: str = "Column", threshold: float = 0.0, primary: tuple[str, ...] = (), names: tuple = ("orders", "changed"), named: bool = True, rows: int | None = None) -> str:
    """SQL of the report of two result queries.

    fields: (alias, aggregate or NULL, column or NULL, "int", "time", "float" (decimals in the default mode), "double", "text" or "value").
    """
    quote = lambda x: "NULL" if x is None else f"'{x}'"
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys) or "TRUE"
    texts = [f"""'"{k}": "' || replace(replace(coalesce(CAST(coalesce(s.{k}, t.{k}) AS VARCHAR), 'null'), '\\', '\\\\'), '"', '\\"') || '"'""" for k in keys]
    group = "'{' || " + " || ', ' || ".join(texts) + " || '}'" if keys else "CAST(NULL AS VARCHAR)"
    parts = []
    for alias, aggregate, column, form in fields:
        forms = {"time": "epoch({})", "float": "round(CAST({} AS FLOAT), 4)", "double": "CASE WHEN NOT isnan({0}) THEN {0} END"}
        a, b = (forms.get(form, "{}").format(f"{x}.{alias}") for x in "st")
        if form in ("text", "value"):
            difference = pct = "CAST(NULL AS DOUBLE)"
            status = f"CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 'success' ELSE 'fail' END"
        else:
            difference = f"CAST({b} - {a} AS DOUBLE)"
            pct = f"CASE WHEN {a} = {b} THEN 0.0::DOUBLE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE 100.0::DOUBLE * {f"CAST(CAST({difference} AS FLOAT) AS DOUBLE)" if form in ("float", "double") else difference} / CAST(CASE WHEN {a} = 0 THEN {b} ELSE {a} END AS DOUBLE) END"
            status = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'success' WHEN {a} IS NULL OR {b} IS NULL THEN 'fail' WHEN abs({pct}) > {threshold} THEN 'fail' ELSE 'success' END"
        in_s, in_t = "s.in_side IS NOT NULL", "t.in_side IS NOT NULL"
        whole = f"{in_s} AND {in_t}"
        of = lambda value, here: f"CASE WHEN {here} THEN {value} END"
        name_s, name_t = (quote(n) if named else of(quote(n), h) for n, h in zip(names, (in_s, in_t), strict=True))
        parts.append(
            f"SELECT '{alias}' AS validation_name, '{kind}' AS validation_type, CAST({quote(aggregate)} AS VARCHAR) AS aggregation_type, CAST({name_s} AS VARCHAR) AS source_table_name, CAST({of(quote(column), in_s)} AS VARCHAR) AS source_column_name, "
            f"CAST(s.{alias} AS VARCHAR) AS source_agg_value, CAST({name_t} AS VARCHAR) AS target_table_name, CAST({of(quote(column), in_t)} AS VARCHAR) AS target_column_name, CAST(t.{alias} AS VARCHAR) AS target_agg_value, {group} AS group_by_columns, "
            f"CAST({of(quote('{' + ', '.join(primary) + '}') if primary else 'NULL', in_s)} AS VARCHAR) AS primary_keys, CAST({of(rows or 'NULL', in_s)} AS BIGINT) AS num_random_rows, "
            f"{of(difference, whole)} AS difference, {of(pct, whole)} AS pct_difference, CAST({of(threshold, whole)} AS DOUBLE) AS pct_threshold, CASE WHEN {whole} THEN {status} ELSE 'fail' END AS validation_status "
            f"FROM s FULL OUTER JOIN t ON {on}"
        )
    return f"WITH changed AS ({CHANGED_ORDERS}), s AS (SELECT *, TRUE AS in_side FROM ({source})), t AS (SELECT *, TRUE AS in_side FROM ({target}))\n" + "\nUNION ALL\n".join(parts)


def orders_sql(select: str, fields: list, group: str = "", where: tuple[str, str] = ("", ""), **more) -> str:
    """report_sql of one query over orders and over their changed copy."""
    one = lambda name, w: f"SELECT {select} FROM {name} {w} {group}"
    return report_sql(one("orders", where[0]), one("changed", where[1]), fields, **more)


DEC = "CAST(o_totalprice AS DECIMAL(18,2))"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# Scans ------------------------------------------------------------------------------------------
register("scan_parquet", lambda spark, d: table(spark, d, "orders"), "SELECT * FROM orders")


def scan_text(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/concord-scan-{kind}-{uuid4().hex}"
        table(spark, sf_dir, "nation").write.format(kind).option("header", "true").save(path)
        return connect(spark, {"source_type": "FileSystem", "table_name": "nation", "file_path": path, "file_type": kind}).table(None, "nation").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))

    return run


for kind in ("csv", "json", "orc"):
    register(f"scan_{kind}", scan_text(kind), "SELECT n_nationkey, n_name, n_regionkey FROM nation")


def custom_query_scan(spark, sf_dir):
    c = connect(spark, {"source_type": "FileSystem", "table_name": "orders_file", "file_path": f"{sf_dir}/orders.parquet", "file_type": "parquet"})
    return c.query("SELECT O_OrderStatus, count(*) AS Orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS TOTAL FROM orders_file GROUP BY O_OrderStatus")


register("custom_query_scan", custom_query_scan, f"SELECT o_orderstatus, count(*) AS orders, CAST(sum({DEC}) AS DECIMAL(28,2)) AS total FROM orders GROUP BY 1")


def table_schemas(spark, sf_dir):
    rows = [(t, c, k) for t in TABLES for c, k in schema_names(table(spark, sf_dir, t).schema).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


register(
    "table_schema",
    table_schemas,
    """SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'float64' WHEN 'VARCHAR' THEN 'string'
       WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'TIMESTAMP_NS' THEN 'timestamp' WHEN 'FLOAT[]' THEN 'array<float32>' ELSE data_type END AS column_type
       FROM information_schema.columns WHERE table_name IN ("""
    + ", ".join(f"'{t}'" for t in TABLES)
    + ")",
)

# Filters ----------------------------------------------------------------------------------------
ROWS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE "
register("filter_custom", filtered_orders({"type": "custom", "source": "o_totalprice > 1000 AND o_orderstatus <> 'P'", "target": "TRUE"}), ROWS + "o_totalprice > 1000 AND o_orderstatus <> 'P'")
register("filter_equals", filtered_orders(by_value("o_orderstatus", "equals", "F")), ROWS + "o_orderstatus = 'F'")
register("filter_isin", filtered_orders(by_value("o_orderstatus", "isin", ["F", "O"])), ROWS + "o_orderstatus IN ('F', 'O')")
register("filter_isin_long", filtered_orders(by_value("o_orderkey", "isin", list(range(0, 30_000, 7)))), ROWS + "o_orderkey % 7 = 0 AND o_orderkey < 30000")
register("filter_greater_less", filtered_orders(by_value("o_totalprice", "greater_than", 1000.0), by_value("O_TOTALPRICE", "less_than", 200000.0)), ROWS + "o_totalprice > 1000 AND o_totalprice < 200000")
register("filter_or", filtered_orders({"type": "or", "filters": [by_value("o_orderstatus", "equals", "F"), by_value("o_orderkey", "less_than", 100)]}), ROWS + "o_orderstatus = 'F' OR o_orderkey < 100")

# Calculated fields --------------------------------------------------------------------------------
O, C = ("o_orderkey",), ("c_custkey",)
register("calc_cast", calculated("orders", O, calc("v", "cast", "o_totalprice", default_cast="decimal(18,2)")), f"SELECT o_orderkey, {DEC} AS value FROM orders")
register("calc_ifnull", lambda spark, d: prepared(changed_orders(table(spark, d, "orders")), ValidationSpec.from_dict({"type": "Row", "calculated_fields": [calc("v", "ifnull", "o_orderpriority")]}), SOURCE).select("o_orderkey", F.col("v").alias("value")), f"SELECT o_orderkey, coalesce(o_orderpriority, 'DEFAULT_REPLACEMENT_STRING') AS value FROM ({CHANGED_ORDERS})")
register(
    "calc_rstrip",
    lambda spark, d: prepared(table(spark, d, "customer").withColumn("padded", F.concat("c_name", F.lit(" \t "))), ValidationSpec.from_dict({"type": "Row", "calculated_fields": [calc("v", "rstrip", "padded")]}), SOURCE).select("c_custkey", F.col("v").alias("value")),
    "SELECT c_custkey, regexp_replace(c_name || ' ' || chr(9) || ' ', '\\s+$', '') AS value FROM customer",
)
register("calc_upper", calculated("customer", C, calc("v", "upper", "c_mktsegment")), "SELECT c_custkey, upper(c_mktsegment) AS value FROM customer")
register("calc_concat", calculated("customer", C, calc("v", "concat", "c_custkey", "c_name", "c_mktsegment", default_concat_separator="|")), "SELECT c_custkey, concat_ws('|', c_custkey, c_name, c_mktsegment) AS value FROM customer")
register("calc_hash", calculated("customer", C, calc("v", "hash", "c_name")), "SELECT c_custkey, sha256(c_name) AS value FROM customer")
register("calc_hash_farm", calculated("customer", C, calc("v", "hash", "c_name", default_hash_function="farm_fingerprint")))
register("calc_length", calculated("customer", C, calc("v", "length", "c_name")), "SELECT c_custkey, length(c_name) AS value FROM customer")
register("calc_byte_length", calculated("documents", ("doc_id",), calc("v", "byte_length", "text")), "SELECT doc_id, strlen(text) AS value FROM documents")
register("calc_epoch_seconds", calculated("orders", O, calc("v", "epoch_seconds", "o_orderdate")), "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS value FROM orders")
register("calc_to_char", calculated("part", ("p_partkey",), calc("v", "to_char", "p_size", default_to_char_fmt="FM990")), "SELECT p_partkey, CAST(p_size AS VARCHAR) AS value FROM part")
register("calc_strftime", calculated("orders", O, calc("v", "custom", "o_orderdate", ibis_expr="TemporalValue.strftime", params=[{"format_str": "%Y/%m/%d %H:%M:%S"}])), "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS value FROM orders")
register("calc_custom_replace", calculated("customer", C, calc("v", "custom", "c_name", ibis_expr="StringValue.replace", params=[{"pattern": "Customer"}, {"replacement": "C."}])), "SELECT c_custkey, replace(c_name, 'Customer', 'C.') AS value FROM customer")
register("calc_bool_string", lambda spark, d: prepared(table(spark, d, "labels").withColumn("flag", F.col("toxic") == 1), ValidationSpec.from_dict({"type": "Row", "calculated_fields": [calc("v", "cast", "flag", default_cast="bool_string")]}), SOURCE).select("doc_id", F.col("v").alias("value")), "SELECT doc_id, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS value FROM labels")
register("calc_staged", calculated("customer", C, calc("a", "cast", "c_custkey"), calc("b", "concat", "a", "c_name", depth=1), calc("v", "hash", "b", depth=2)), "SELECT c_custkey, sha256(concat(c_custkey, c_name)) AS value FROM customer")

# Aggregates and column validation ---------------------------------------------------------------
for kind, column, select, form in (
    ("count", None, "count(*) AS x", "int"),
    ("count", "o_orderpriority", "count(o_orderpriority) AS x", "int"),
    ("sum", "price", f"sum({DEC}) AS x", "int"),
    ("min", "price", f"min({DEC}) AS x", "int"),
    ("max", "o_orderdate", "max(o_orderdate) AS x", "time"),
    ("bit_xor", "o_orderkey", "bit_xor(o_orderkey) AS x", "int"),
):
    name = "agg_count_col" if column == "o_orderpriority" else f"agg_{kind}"
    register(name, orders_report(calculated_fields=[PRICE], aggregates=[agg("x", kind, column)]), orders_sql(select, [("x", kind, column, form)]))
register("agg_avg", orders_report(calculated_fields=[PRICE], aggregates=[agg("x", "avg", "price", "decimal(20,3)")]), orders_sql(f"CAST(avg({DEC}) AS DECIMAL(20,3)) AS x", [("x", "avg", "price", "int")]))
register("agg_std", orders_report(aggregates=[agg("x", "std", "o_totalprice", "decimal(20,3)")]), orders_sql("CAST(stddev_samp(o_totalprice) AS DECIMAL(20,3)) AS x", [("x", "std", "o_totalprice", "int")]))
register(
    "agg_big_decimal",
    orders_report(calculated_fields=[calc("big", "cast", "o_totalprice", default_cast="decimal(30,2)")], aggregates=[agg("x", "sum", "big", "string")]),
    orders_sql("CAST(sum(CAST(o_totalprice AS DECIMAL(30,2))) AS VARCHAR) AS x", [("x", "sum", "big", "text")]),
)


def wildcard(spark, sf_dir):
    s, t = (x.drop("o_totalprice") for x in both(spark, sf_dir))
    fields, aggregates = expand.column_validation(s.schema, t.schema, {"sum": "*", "min": "*", "count": "*"}, string_lengths=True, timestamps=True)
    spec = ValidationSpec("Column", table_name="orders", target_table_name="changed", calculated_fields=fields, aggregates=aggregates, exact=True)
    return shown(validate(s, t, spec))


W = [("count", "count", None, "int")]
W_SELECT = ["count(*) AS count"]
for a in ("sum", "min", "count"):
    for c, length in (("o_orderkey", 0), ("o_custkey", 0), ("o_orderstatus", 1), ("o_orderdate", 0), ("o_orderpriority", 1)):
        own, alias = (f"length({c})", f"{a}__length__{c}") if length else (f"CAST(epoch({c}) AS BIGINT)", f"{a}__epoch_seconds__{c}") if a == "sum" and c == "o_orderdate" else (c, f"{a}__{c}")
        column = alias.split("__", 1)[1]
        W.append((alias, a, column, "time" if a == "min" and c == "o_orderdate" else "int"))
        W_SELECT.append(f"CAST({a}({own}) AS BIGINT) AS {alias}" if a != "min" or c != "o_orderdate" else f"{a}({own}) AS {alias}")
register("wildcard_aggregates", wildcard, orders_sql(", ".join(W_SELECT), W))

STATUS = [pair("o_orderstatus")]
G = {"calculated_fields": [PRICE], "aggregates": [agg("n", "count"), agg("total", "sum", "price"), agg("latest", "max", "o_orderdate")], "grouped_columns": STATUS, "threshold": 1.0}
G_SQL = orders_sql(f"o_orderstatus, count(*) AS n, sum({DEC}) AS total, max(o_orderdate) AS latest", [("n", "count", None, "int"), ("total", "sum", "price", "int"), ("latest", "max", "o_orderdate", "time")], "GROUP BY 1", keys=("o_orderstatus",), threshold=1.0)
register("group_by", orders_report(**G), G_SQL)
register("group_by_ts_to_date", orders_report(aggregates=[agg("n", "count")], grouped_columns=[pair("o_orderdate", "day")]), orders_sql("CAST(o_orderdate AS DATE) AS day, count(*) AS n", [("n", "count", None, "int")], "GROUP BY 1", keys=("day",)))
register("multi_group", orders_report(aggregates=[agg("n", "count")], grouped_columns=[pair("o_orderstatus"), pair("o_orderpriority")], threshold=2.5), orders_sql("o_orderstatus, o_orderpriority, count(*) AS n", [("n", "count", None, "int")], "GROUP BY 1, 2", keys=("o_orderstatus", "o_orderpriority"), threshold=2.5))
register("threshold_status", orders_report(aggregates=[agg("n", "count")], grouped_columns=[pair("o_orderpriority")], threshold=0.5), orders_sql("o_orderpriority, count(*) AS n", [("n", "count", None, "int")], "GROUP BY 1", keys=("o_orderpriority",), threshold=0.5))
register("unmatched_groups", orders_report(aggregates=[agg("n", "count")], grouped_columns=[pair("o_orderkey")]), orders_sql("o_orderkey, count(*) AS n", [("n", "count", None, "int")], "GROUP BY 1", keys=("o_orderkey",)))
register("zero_divisor", orders_report(aggregates=[agg("n", "count")], filters=[{"type": "custom", "source": "o_orderkey < 0", "target": "TRUE"}]), orders_sql("count(*) AS n", [("n", "count", None, "int")], "", ("WHERE o_orderkey < 0", "")))
register("null_one_sided", orders_report(calculated_fields=[PRICE], aggregates=[agg("total", "sum", "price"), agg("n", "count", "o_orderpriority")], filters=[{"type": "custom", "source": "TRUE", "target": "o_orderkey < 0"}]), orders_sql(f"sum({DEC}) AS total, count(o_orderpriority) AS n", [("total", "sum", "price", "int"), ("n", "count", "o_orderpriority", "int")], "", ("", "WHERE o_orderkey < 0")))
#: The default mode: small integers as floats, where rounding changes nothing.
register("float_mode", orders_report(exact=False, calculated_fields=[calc("small", "cast", "o_custkey", default_cast="decimal(10,0)")], aggregates=[agg("x", "max", "small")], grouped_columns=STATUS), orders_sql("o_orderstatus, max(CAST(o_custkey AS DECIMAL(10,0))) AS x", [("x", "max", "small", "int")], "GROUP BY 1", keys=("o_orderstatus",)))


#: The default mode on sums of prices, which floats round.
register("float_decimals", orders_report(exact=False, **G), report_sql(f"SELECT o_orderstatus, count(*) AS n, sum({DEC}) AS total, max(o_orderdate) AS latest FROM orders GROUP BY 1", f"SELECT o_orderstatus, count(*) AS n, sum({DEC}) AS total, max(o_orderdate) AS latest FROM changed GROUP BY 1", [("n", "count", None, "int"), ("total", "sum", "price", "float"), ("latest", "max", "o_orderdate", "time")], keys=("o_orderstatus",), threshold=1.0))


def sum_overflow(spark, sf_dir):
    """Sums of bigints that leave a bigint's range, of sides that differ."""
    spec = ValidationSpec.from_dict({"type": "Column", "aggregates": [agg("total", "sum", "big"), agg("n", "count")], "grouped_columns": [pair("o_orderpriority")]} | EXACT)
    s, t = (x.withColumn("big", F.col("o_orderkey") % 100_000 * 90_000_000_000_000) for x in both(spark, sf_dir))
    return shown(validate(s, t, spec))


BIG = "sum(CAST(o_orderkey % 100000 * 90000000000000 AS HUGEINT))"
register("agg_sum_overflow", sum_overflow, orders_sql(f"o_orderpriority, {BIG} AS total, count(*) AS n", [("total", "sum", "big", "int"), ("n", "count", None, "int")], "GROUP BY 1", keys=("o_orderpriority",)))


def limited(spark, sf_dir):
    """Rows of a side of which at most so many are taken; which ones is open, their number isn't."""
    spec = ValidationSpec.from_dict(KEY | {"comparison_fields": [pair("o_custkey")], "limit": 500})
    return side_frame(table(spark, sf_dir, "orders"), spec, SOURCE).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))


KEY = {"type": "Row", "primary_keys": [pair("o_orderkey")]}
register("limit", limited, "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM (SELECT * FROM orders LIMIT 500)")

# Rows ---------------------------------------------------------------------------------------------
R_FIELDS = [("o_orderstatus", None, "o_orderstatus", "value"), ("price", None, "price", "value"), ("o_orderpriority", None, "o_orderpriority", "value"), ("o_orderdate", None, "o_orderdate", "value")]
R_MORE = {"keys": ("o_orderkey",), "kind": "Row", "primary": ("o_orderkey",)}
register("row_comparison", orders_report(**KEY, calculated_fields=[PRICE], comparison_fields=[pair(f[0]) for f in R_FIELDS]), orders_sql(f"o_orderkey, o_orderstatus, {DEC} AS price, o_orderpriority, o_orderdate", R_FIELDS, **R_MORE))


def row_text(kind: str, ignore_case: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        s, t = (x.drop("o_totalprice") for x in both(spark, sf_dir))
        if ignore_case:
            t = t.withColumn("o_orderpriority", F.lower("o_orderpriority"))
        fields, pairs = expand.row_pipeline(kind, "*", s.schema, t.schema, ignore_case=ignore_case)
        spec = ValidationSpec("Row", table_name="orders", target_table_name="changed", primary_keys=expand.key_pairs("o_orderkey", s.schema, t.schema), calculated_fields=fields, comparison_fields=pairs, case_insensitive_match=ignore_case, exact=True)
        return shown(validate(s, t, spec))

    return run


ROW_TEXT = "CAST(o_orderkey AS VARCHAR) || CAST(o_custkey AS VARCHAR) || coalesce(rtrim(o_orderstatus), 'DEFAULT_REPLACEMENT_STRING') || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || coalesce(rtrim(o_orderpriority), 'DEFAULT_REPLACEMENT_STRING')"
register("row_concat", row_text("concat"), orders_sql(f"o_orderkey, {ROW_TEXT} AS concat__all", [("concat__all", None, "concat__all", "value")], **R_MORE))
register("row_hash", row_text("hash"), orders_sql(f"o_orderkey, sha256({ROW_TEXT}) AS hash__all", [("hash__all", None, "hash__all", "value")], **R_MORE))
register("row_case_insensitive", row_text("hash", True), orders_sql(f"o_orderkey, sha256(upper({ROW_TEXT})) AS hash__all", [("hash__all", None, "hash__all", "value")], **R_MORE))


def custom_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    spec = ValidationSpec.from_dict({"type": "Custom-query", "custom_query_type": kind, "exact": True, "primary_keys": [pair("o_orderkey")] if kind == "row" else [], "comparison_fields": [pair("o_custkey")] if kind == "row" else [], "aggregates": [] if kind == "row" else [agg("n", "count"), agg("keys", "sum", "o_orderkey")]})

    def run(spark, sf_dir):
        s, t = both(spark, sf_dir)
        s.createOrReplaceTempView("concord_orders")
        t.createOrReplaceTempView("concord_changed")
        c = connect(spark, {"source_type": "Spark"})
        a, b = (c.query(f"SELECT O_ORDERKEY, O_CUSTKEY FROM {x} WHERE o_orderstatus = 'F'") for x in ("concord_orders", "concord_changed"))
        return shown(validate(a, b, spec))

    return run


F_ONLY = ("WHERE o_orderstatus = 'F'",) * 2
register("custom_query_row", custom_query("row"), orders_sql("o_orderkey, o_custkey", [("o_custkey", None, "o_custkey", "value")], "", F_ONLY, **(R_MORE | {"kind": "Custom-query"}), names=(None, None), named=False))
register("custom_query_column", custom_query("column"), orders_sql("count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys", [("n", "count", None, "int"), ("keys", "sum", "o_orderkey", "int")], "", F_ONLY, kind="Custom-query", names=(None, None), named=False))


def drilldown(spark, sf_dir):
    s, t = both(spark, sf_dir)
    spec = ValidationSpec.from_dict(KEY | EXACT | {"aggregates": [agg("n", "count")], "grouped_columns": [pair("o_orderstatus"), pair("o_orderdate", "day")], "comparison_fields": [pair("o_orderstatus")]})
    return shown(validate(s, t, spec))


def day_level(here: str) -> str:
    return f"SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM {here} GROUP BY 1, 2"


DRILL = f"""
WITH changed AS ({CHANGED_ORDERS}),
g1 AS (SELECT coalesce(s.k, t.k) AS k, s.n AS a, t.n AS b FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1) s FULL JOIN (SELECT o_orderstatus AS k, count(*) AS n FROM changed GROUP BY 1) t ON s.k = t.k),
g2 AS (SELECT coalesce(s.o_orderstatus, t.o_orderstatus) AS k, coalesce(s.day, t.day) AS day, s.n AS a, t.n AS b FROM ({day_level("orders")}) s FULL JOIN ({day_level("changed")}) t ON s.o_orderstatus = t.o_orderstatus AND s.day = t.day
       WHERE coalesce(s.o_orderstatus, t.o_orderstatus) IN (SELECT k FROM g1 WHERE a IS DISTINCT FROM b)),
bad AS (SELECT k, day FROM g2 WHERE a IS DISTINCT FROM b AND coalesce(greatest(a, b), 0) <= 50000),
s AS (SELECT o.* FROM orders o JOIN bad ON k = o_orderstatus AND day = CAST(o_orderdate AS DATE)),
t AS (SELECT o.* FROM changed o JOIN bad ON k = o_orderstatus AND day = CAST(o_orderdate AS DATE)),
kept AS (SELECT k, CAST(NULL AS DATE) AS day, a, b FROM g1 WHERE a IS NOT DISTINCT FROM b
         UNION ALL SELECT k, day, a, b FROM g2 WHERE a IS NOT DISTINCT FROM b OR coalesce(greatest(a, b), 0) > 50000)
SELECT 'n' AS validation_name, 'Row' AS validation_type, 'count' AS aggregation_type, 'orders' AS source_table_name, CAST(NULL AS VARCHAR) AS source_column_name, CAST(a AS VARCHAR) AS source_agg_value, 'changed' AS target_table_name,
       CAST(NULL AS VARCHAR) AS target_column_name, CAST(b AS VARCHAR) AS target_agg_value, '{{"o_orderstatus": "' || k || coalesce('", "day": "' || CAST(day AS VARCHAR), '') || '"}}' AS group_by_columns, CASE WHEN a IS NOT NULL THEN '{{o_orderkey}}' END AS primary_keys,
       CAST(NULL AS BIGINT) AS num_random_rows, CAST(NULL AS DOUBLE) AS difference, CAST(NULL AS DOUBLE) AS pct_difference, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.0::DOUBLE END AS pct_threshold, CASE WHEN a = b THEN 'success' ELSE 'fail' END AS validation_status FROM kept
UNION ALL
SELECT 'o_orderstatus', 'Row', CAST(NULL AS VARCHAR), 'orders', CASE WHEN s.o_orderkey IS NOT NULL THEN 'o_orderstatus' END, s.o_orderstatus, 'changed', CASE WHEN t.o_orderkey IS NOT NULL THEN 'o_orderstatus' END, t.o_orderstatus,
       '{{"o_orderkey": "' || CAST(coalesce(s.o_orderkey, t.o_orderkey) AS VARCHAR) || '"}}', CASE WHEN s.o_orderkey IS NOT NULL THEN '{{o_orderkey}}' END, NULL, NULL, NULL, CASE WHEN s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL THEN 0.0::DOUBLE END, CASE WHEN s.o_orderstatus = t.o_orderstatus THEN 'success' ELSE 'fail' END
FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey
"""
register("drilldown", drilldown, DRILL)


def random_row(spark, sf_dir):
    """A sample's report: its rows, how many have their sample's size, and how many differ just where the target lacks them."""
    report = validate(*both(spark, sf_dir), ValidationSpec.from_dict(KEY | EXACT | {"use_random_rows": True, "random_row_batch_size": 100, "comparison_fields": [pair("o_custkey")]}), seed=1)
    key = F.regexp_extract("group_by_columns", "([0-9]+)", 1).cast("long")
    right = (F.col("validation_status") == "fail") == (key % 97 == 0)
    return report.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), F.sum("num_random_rows").alias("sizes"), F.sum(right.cast("int")).alias("as_expected"))


register("random_rows", random_row, "SELECT least(count(*), 100) AS n, n AS keys, n * 100 AS sizes, n AS as_expected FROM orders")


def hashed_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keys = orders.orderBy(F.sha2(F.col("o_orderkey").cast("string"), 256)).limit(100).select(F.col("o_orderkey").alias("key"))
    return in_sample(orders, "o_orderkey", keys, 100)


register("limit_topk", hashed_sample, "SELECT * FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR)) LIMIT 100")


def status_filter(spark, sf_dir):
    from concord.sources.reports import with_status

    return with_status(orders_report(**G | {"threshold": 0.0})(spark, sf_dir), ["fail"])


G_STRICT = orders_sql(f"o_orderstatus, count(*) AS n, sum({DEC}) AS total, max(o_orderdate) AS latest", [("n", "count", None, "int"), ("total", "sum", "price", "int"), ("latest", "max", "o_orderdate", "time")], "GROUP BY 1", keys=("o_orderstatus",))
register("status_filter", status_filter, f"SELECT * FROM ({G_STRICT}) WHERE validation_status = 'fail'")


def kernel_values(spark, sf_dir):
    """Escaped and null keys, floats and NaN through the kernel itself."""
    key = F.when(F.col("n_nationkey") % 5 == 0, F.lit('a"b\\c')).when(F.col("n_nationkey") % 5 != 1, F.col("n_name"))
    s = table(spark, sf_dir, "nation").select(key.alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("n_nationkey") * 0.5).alias("x"))
    t = s.withColumn("x", F.when(F.col("k") != "CHINA", F.col("x") * 2).otherwise(F.col("x")))
    return shown(compare(s, t, Comparison((ReportedField("x", "x", "x"),), ("k",), "Column", "s", "t", 50.0)))


ESCAPED = """SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'a"b\\c' WHEN n_nationkey % 5 <> 1 THEN n_name END AS k, CASE WHEN n_nationkey % 2 = 0 THEN CAST('nan' AS DOUBLE) ELSE n_nationkey * 0.5::DOUBLE END AS x FROM nation"""
KERNEL = report_sql(ESCAPED, f"SELECT k, CASE WHEN k <> 'CHINA' THEN x * 2 ELSE x END AS x FROM ({ESCAPED})", [("x", None, "x", "double")], keys=("k",), names=("s", "t"), threshold=50.0)
named = lambda c: f"CASE {c} WHEN 'nan' THEN 'NaN' ELSE {c} END AS {c}"
register("kernel_values", kernel_values, f"SELECT * REPLACE ({named('source_agg_value')}, {named('target_agg_value')}) FROM ({KERNEL})")

def two_sides(name: str, change_source, change_target, **config) -> Callable[[SparkSession, str], DataFrame]:
    """Query of a validation of a table against itself, each side changed in its own way."""
    spec = ValidationSpec.from_dict({"type": "Row", "table_name": "a", "target_table_name": "b"} | config)
    return lambda spark, sf_dir: shown(validate(change_source(table(spark, sf_dir, name)), change_target(table(spark, sf_dir, name)), spec))


A_B = {"kind": "Row", "names": ("a", "b")}
register(
    "key_binary_hex",
    two_sides("customer", lambda d: d.withColumn("k", F.encode("c_name", "UTF-8")), lambda d: d.where("c_custkey % 10 > 0").withColumn("k", F.encode("c_name", "UTF-8")), primary_keys=[pair("k", cast="string")], comparison_fields=[pair("c_nationkey")]),
    report_sql("SELECT lower(hex(encode(c_name))) AS k, c_nationkey FROM customer", "SELECT lower(hex(encode(c_name))) AS k, c_nationkey FROM customer WHERE c_custkey % 10 > 0", [("c_nationkey", None, "c_nationkey", "value")], keys=("k",), primary=("k",), **A_B),
)
register(
    "key_trim",
    two_sides("customer", lambda d: d.withColumn("c_name", F.concat("c_name", F.lit(" \t"))), lambda d: d, primary_keys=[pair("c_name")], comparison_fields=[pair("c_mktsegment")], trim_string_pks=True),
    report_sql("SELECT c_name, c_mktsegment FROM customer", "SELECT c_name, c_mktsegment FROM customer", [("c_mktsegment", None, "c_mktsegment", "value")], keys=("c_name",), primary=("c_name",), **A_B),
)
register(
    "bool_comparison",
    two_sides("labels", lambda d: d.withColumn("flag", F.col("toxic") == 1), lambda d: d.withColumn("flag", F.when(F.col("doc_id") % 9 > 0, F.col("toxic"))), primary_keys=[pair("doc_id")], comparison_fields=[pair("flag", cast="bool")]),
    report_sql("SELECT doc_id, toxic = 1 AS flag FROM labels", "SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN toxic = 1 END AS flag FROM labels", [("flag", None, "flag", "value")], keys=("doc_id",), primary=("doc_id",), **A_B),
)
register(
    "null_keys",
    two_sides("nation", lambda d: d.withColumn("k", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey"))).where("n_nationkey <> 4"), lambda d: d.withColumn("k", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey"))).where("n_nationkey <> 0"), primary_keys=[pair("k")], comparison_fields=[pair("n_name")]),
    report_sql("SELECT CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS k, n_name FROM nation WHERE n_nationkey <> 4", "SELECT CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS k, n_name FROM nation WHERE n_nationkey <> 0", [("n_name", None, "n_name", "value")], keys=("k",), primary=("k",), **A_B),
)
register(
    "repeated_keys",
    two_sides("nation", lambda d: d, lambda d: d, primary_keys=[pair("n_regionkey")], comparison_fields=[pair("n_name")]),
    report_sql("SELECT n_regionkey, n_name FROM nation", "SELECT n_regionkey, n_name FROM nation", [("n_name", None, "n_name", "value")], keys=("n_regionkey",), primary=("n_regionkey",), **A_B),
)
register(
    "agg_epoch_seconds",
    orders_report(calculated_fields=[calc("t", "epoch_seconds", "o_orderdate")], aggregates=[agg("total", "sum", "t"), agg("mixed", "bit_xor", "t")]),
    orders_sql("CAST(sum(CAST(epoch(o_orderdate) AS BIGINT)) AS BIGINT) AS total, bit_xor(CAST(epoch(o_orderdate) AS BIGINT)) AS mixed", [("total", "sum", "t", "int"), ("mixed", "bit_xor", "t", "int")]),
)
register(
    "group_cast",
    orders_report(aggregates=[agg("n", "count")], grouped_columns=[pair("o_totalprice", "whole", "bigint")]),
    orders_sql("CAST(trunc(o_totalprice) AS BIGINT) AS whole, count(*) AS n", [("n", "count", None, "int")], "GROUP BY 1", keys=("whole",)),
)


def row_chunks(spark, sf_dir):
    """Hashes of at most two columns each, as where an engine limits the columns of a text."""
    s, t = (x.drop("o_totalprice") for x in both(spark, sf_dir))
    out = []
    for chunk in expand.column_chunks([c for c in s.columns if c != "o_orderkey"], 2):
        fields, pairs = expand.row_pipeline("hash", chunk, s.schema, t.schema)
        out.append(shown(validate(s, t, ValidationSpec("Row", table_name="orders", target_table_name="changed", primary_keys=expand.key_pairs("o_orderkey", s.schema, t.schema), calculated_fields=fields, comparison_fields=pairs))))
    return reduce(DataFrame.unionByName, out)


HALVES = ("CAST(o_custkey AS VARCHAR) || coalesce(rtrim(o_orderstatus), 'DEFAULT_REPLACEMENT_STRING')", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || coalesce(rtrim(o_orderpriority), 'DEFAULT_REPLACEMENT_STRING')")
register("row_column_chunks", row_chunks, " UNION ALL ".join(f"SELECT * FROM ({orders_sql(f'o_orderkey, sha256({x}) AS hash__all', [('hash__all', None, 'hash__all', 'value')], **R_MORE)})" for x in HALVES))


def config_runner(spark, sf_dir):
    """The grouped validation, written as a YAML file and run from it over file connections."""
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/concord-runner-{uuid4().hex}"
    changed_orders(table(spark, sf_dir, "orders")).write.parquet(f"{root}/changed")
    files = Files(spark, root if "://" in root or not root.startswith("file:") else f"file://{root.removeprefix('file:')}")
    one = lambda path: {"source_type": "FileSystem", "table_name": "t", "file_path": path, "file_type": "parquet"}
    spec = ValidationSpec.from_dict({"type": "Column", "source_conn": one(f"{sf_dir}/orders.parquet"), "target_conn": one(f"{root}/changed")} | EXACT | G)
    files.write("0000.yaml", format_document({"validations": [spec.to_dict()]}, "0000.yaml"))
    (read,) = load_specs(parse_document(files.read("0000.yaml"), "0000.yaml"))
    return shown(Runner(spark).report(read))


register("config_runner", config_runner, G_SQL)


def schema_self(spark, sf_dir):
    """Every table's schema against itself."""
    return reduce(DataFrame.unionByName, [validate(x, x, ValidationSpec("Schema", table_name=n, target_table_name=n)) for n in TABLES for x in [table(spark, sf_dir, n)]]).groupBy("source_table_name", "validation_status").agg(F.count(F.lit(1)).alias("n"))


register("schema_self", schema_self, "SELECT table_name AS source_table_name, 'success' AS validation_status, count(*) AS n FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ") GROUP BY 1")


# Schemas --------------------------------------------------------------------------------------------


def schema_report(**config) -> Callable[[SparkSession, str], DataFrame]:
    spec = ValidationSpec.from_dict({"type": "Schema", "table_name": "orders", "target_table_name": "changed"} | config)

    def run(spark, sf_dir):
        s, _ = both(spark, sf_dir)
        s = s.withColumn("only_source", F.lit(1)).withColumn("amount", F.lit(1).cast("decimal(5,2)"))
        t = s.drop("only_source").withColumn("O_CUSTKEY", F.col("o_custkey").cast("string")).withColumn("only_target", F.lit("x")).withColumn("amount", F.lit(1).cast("decimal(10,2)"))
        columns = [c for c in SHOWN if c != "pct_difference"]
        return validate(s, t, spec).select(*columns)

    return run


def schema_sql(rows: list[tuple[str, str, str, str, str]]) -> str:
    values = ", ".join(f"('{a}', '{x}', '{b}', '{y}', '{s}')" for a, b, x, y, s in rows)
    nulls = ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in (("group_by_columns", "VARCHAR"), ("primary_keys", "VARCHAR"), ("num_random_rows", "BIGINT"), ("difference", "DOUBLE"), ("pct_threshold", "DOUBLE")))
    return f"SELECT 'Schema' AS validation_name, 'Schema' AS validation_type, 'Schema' AS aggregation_type, 'orders' AS source_table_name, source_column_name, source_agg_value, 'changed' AS target_table_name, target_column_name, target_agg_value, {nulls}, validation_status FROM (VALUES {values}) AS v(source_column_name, source_agg_value, target_column_name, target_agg_value, validation_status)"


SAME = [(c, c, k, k, "success") for c, k in (("o_orderkey", "int64"), ("o_orderstatus", "string"), ("o_totalprice", "float64"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string"))]
ENDS = [("only_source", "N/A", "!int32", "N/A", "fail"), ("N/A", "only_target", "N/A", "!string", "fail")]
WIDER = [("amount", "amount", "decimal(5,2)", "decimal(10, 2)", "success")]
register("schema_compare", schema_report(), schema_sql([*SAME, ("o_custkey", "o_custkey", "int64", "string", "fail"), *WIDER, *ENDS]))
register("schema_allow_list", schema_report(allow_list="int64:string,int8:int16", exclusion_columns=["ONLY_SOURCE"]), schema_sql([*SAME, ("o_custkey", "o_custkey", "int64", "string", "success"), *WIDER, ENDS[1]]))

# Partitions, tables ---------------------------------------------------------------------------------


def partition_bounds(spark, sf_dir):
    first = boundaries(table(spark, sf_dir, "orders"), ["o_orderkey"], 7)
    return spark.createDataFrame([(i, k) for i, (k,) in enumerate(first)], "part int, first_key long")


NUMBERED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS c FROM orders"
register("partition_bounds", partition_bounds, f"SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS part, o_orderkey AS first_key FROM ({NUMBERED}) WHERE (r * 7) % c > 0 AND (r * 7) % c <= 7")


def partition_counts(spark, sf_dir):
    """Rows of the source in each range, and of ranges by the predicates' own text."""
    s, t = both(spark, sf_dir)
    spec = ValidationSpec.from_dict(KEY)
    filters = partition_filters(s, t, spec, 7)
    one = lambda i, f: s.where(f.source).agg(F.lit(i).alias("part"), F.count(F.lit(1)).alias("source_rows"))
    other = lambda i, f: t.where(f.target).agg(F.lit(i).alias("part"), F.count(F.lit(1)).alias("target_rows"))
    a, b = (reduce(DataFrame.union, [make(i, f) for i, f in enumerate(filters)]) for make in (one, other))
    return a.join(b, "part")


register(
    "partition_counts",
    partition_counts,
    f"WITH changed AS ({CHANGED_ORDERS}), b AS (SELECT o_orderkey AS k FROM ({NUMBERED}) WHERE (r * 7) % c > 0 AND (r * 7) % c <= 7), low AS (SELECT min(k) AS m FROM b), "
    "n AS (SELECT (SELECT count(*) FROM b WHERE b.k <= o.o_orderkey AND b.k > (SELECT m FROM low)) AS part, 1 AS s, 0 AS t FROM orders o UNION ALL SELECT (SELECT count(*) FROM b WHERE b.k <= o.o_orderkey AND b.k > (SELECT m FROM low)), 0, 1 FROM changed o) "
    "SELECT CAST(part AS INTEGER) AS part, CAST(sum(s) AS BIGINT) AS source_rows, CAST(sum(t) AS BIGINT) AS target_rows FROM n GROUP BY 1",
)


def partition_composite(spark, sf_dir):
    """Rows in ranges of a key of four columns."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(range_number(lines, keys, boundaries(lines, keys, 5)).alias("part")).agg(F.count(F.lit(1)).alias("n"))


register(
    "partition_composite",
    partition_composite,
    "WITH r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER () AS c FROM lineitem) SELECT CAST(ceil(r * 5 / c) - 1 AS INTEGER) AS part, count(*) AS n FROM r GROUP BY 1",
)


def find_tables(spark, sf_dir):
    found = match_tables([("shop", t) for t in TABLES], [("shop", t.rstrip("s")) for t in TABLES], 0.9)
    return spark.createDataFrame([(m["schema_name"], m["table_name"], m["target_schema_name"], m["target_table_name"]) for m in found], "schema_name string, table_name string, target_schema_name string, target_table_name string")


register(
    "find_tables",
    find_tables,
    "WITH n AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, 'shop.{t}', 'shop.{t.rstrip('s')}')" for i, t in enumerate(TABLES))
    + ") AS v(i, a, b)), p AS (SELECT x.a, y.b, jaro_similarity(x.a, y.b) AS s, y.i FROM n x, n y), best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, i DESC) AS r FROM p WHERE s >= 0.9)"
    " SELECT 'shop' AS schema_name, a[6:] AS table_name, 'shop' AS target_schema_name, b[6:] AS target_table_name FROM best WHERE r = 1",
)
register("union_pivot", orders_report(calculated_fields=[PRICE], aggregates=[agg("lo", "min", "price"), agg("hi", "max", "price"), agg("n", "count"), agg("keys", "max", "o_orderkey")]), orders_sql(f"min({DEC}) AS lo, max({DEC}) AS hi, count(*) AS n, max(o_orderkey) AS keys", [("lo", "min", "price", "int"), ("hi", "max", "price", "int"), ("n", "count", None, "int"), ("keys", "max", "o_orderkey", "int")]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_report(**G)(spark, sf_dir)


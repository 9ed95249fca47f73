import json
import threading
import urllib.error
import urllib.request

import pytest

from concord import cli
from concord.arguments import filters, labels, names, positive, result_handler, statuses, table_mappings, table_reference, threshold
from concord.plans.frames import SOURCE, filtered
from concord.plans.spec import Filter, ValidationSpec, load_specs, parse_document
from concord.runner import Runner
from concord.service import server
from concord.sources.connections import FIELDS, JDBC, ConnectionFailure, ConnectionStore, Files, config_from_options, connect, jdbc_options
from concord.sources.reports import HIDDEN, BigQuerySink, TableSink, TextSink, formatted, sink, with_status

ENTRIES = [("a", "x", 1), ("b", "y", 2), ("c", None, 3), ("d", "z", 4), ("e", "z", 5), ("f", "z", 6), ("g", "z", 7)]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Entries in four formats, and a changed copy: paths by name."""
    root = tmp_path_factory.mktemp("files")
    df = spark.createDataFrame(ENTRIES, "guestName string, content string, entryID int").coalesce(1)
    out = {}
    for kind in ("csv", "orc", "parquet"):
        df.write.option("header", "true").format(kind).save(f"{root}/{kind}")
        out[kind] = f"{root}/{kind}"
    (root / "entries.json").write_text(json.dumps([dict(zip(df.columns, r, strict=True)) for r in ENTRIES]))
    out["json"] = f"{root}/entries.json"
    df.where("entryID < 7").write.parquet(f"{root}/changed")
    out["changed"] = f"{root}/changed"
    return out


def file_connection(path, kind):
    return {"source_type": "FileSystem", "table_name": "entries", "file_path": path, "file_type": kind}


# Connections


def test_files_of_all_types(spark, files):
    for kind in ("csv", "json", "orc", "parquet"):
        c = connect(spark, file_connection(files[kind], kind))
        assert c.query("SELECT count(*) AS N, count(guestName) AS g, sum(entryID) AS s FROM entries").first().asDict() == {"n": 7, "g": 7, "s": 28}
        assert c.all_tables() == [(None, "entries")] and c.schemas() == []
    with pytest.raises(ValueError):
        connect(spark, file_connection(files["csv"], "xml")).table(None, None)
    assert connect(spark, file_connection(files["csv"], "csv") | {"schema": "a string, b string, c string"}).table_schema(None, None).fieldNames() == ["a", "b", "c"]


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(3).write.mode("overwrite").saveAsTable("shop.items")
    c = connect(spark, {"source_type": "Spark"})
    assert "shop" in c.schemas() and c.tables("shop") == ["items"] and c.all_tables(["shop", "no_such_schema"]) == [("shop", "items")]
    assert c.table("shop", "items").count() == 3 and c.query_schema("SELECT ID FROM shop.items").fieldNames() == ["id"] and len(c.rows("SELECT * FROM shop.items")) == 3


def test_jdbc_options():
    common = {"host": "h", "user": "u", "user_name": "u", "password": "p", "database": "d", "account": "a", "project_id": "p", "instance_id": "i", "database_id": "d"}
    for kind in JDBC:
        out = jdbc_options({"source_type": kind} | common)
        assert out["url"].startswith("jdbc:") and "{" not in out["url"] and out["user"] == "u" and out["driver"]
    assert jdbc_options({"source_type": "Postgres", "host": "h", "port": 7, "database": "d"})["url"] == "jdbc:postgresql://h:7/d"
    assert jdbc_options({"source_type": "Oracle", "url": "jdbc:oracle:thin:@x", "options": {"fetchsize": 10}}) == {"url": "jdbc:oracle:thin:@x", "driver": "oracle.jdbc.OracleDriver", "fetchsize": "10"}


def test_bad_connections_and_secrets(spark):
    for bad in ({"source_type": "Odd"}, {}, {"source_type": "FileSystem"}, {"source_type": "Snowflake", "user": "u"}):
        with pytest.raises(ConnectionFailure):
            connect(spark, bad)
    secret = {"source_type": "FileSystem", "secret_manager_type": "x", "table_name": "t", "file_path": "p", "file_type": "k"}
    with pytest.raises(ConnectionFailure):
        connect(spark, secret)
    assert connect(spark, secret, {"t": "T", "p": "P", "k": "csv"}.get).config["file_path"] == "P"
    assert config_from_options("Raw", {"json": '{"source_type": "Spark"}'}) == {"source_type": "Spark"}
    assert config_from_options("Postgres", {"host": "h", "port": None, "other": 1}) == {"source_type": "Postgres", "host": "h"}
    assert {"BigQuery", "Teradata", "Oracle", "MSSQL", "MySQL", "Snowflake", "Postgres", "Redshift", "Spanner", "FileSystem", "Impala", "DB2"} <= set(FIELDS)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_store_and_files(spark, tmp_path, scheme):
    store = ConnectionStore(spark, f"{scheme}{tmp_path}/conn")
    assert store.names() == []
    store.create("b", {"source_type": "Spark"})
    store.create("a.x", {"source_type": "Odd"})
    assert store.names() == ["a.x", "b"] and store.get("b") == {"source_type": "Spark"}
    folder = Files(spark, f"{scheme}{tmp_path}/deep")
    folder.write("in/side.txt", "é")
    assert folder.read("in/side.txt") == "é"


# Sinks


def report(spark):
    rows = [("a", "success", 1.0, [("k", "v")]), ("b", "fail", None, []), (None, "fail", 2.0, None)]
    return spark.createDataFrame(rows, "validation_name string, validation_status string, difference double, labels array<struct<key:string,value:string>>")


def test_text_formats(spark, capsys):
    df = report(spark)
    assert formatted(df, "csv") == "validation_name,validation_status,difference,labels\na,success,1.0,k=v\nb,fail,,\n,fail,2.0,\n"
    assert json.loads(formatted(df, "json"))["1"] == {"validation_name": "b", "validation_status": "fail", "difference": None, "labels": []}
    for kind in ("table", "text"):
        out = formatted(df, kind)
        assert "validation_status" in out and "difference" not in out and "success" in out
    assert "╒" in formatted(df, "table") and "difference" in formatted(df, "table", ())
    assert TextSink("csv", ["fail"]).execute(df).count() == 2 and "success" not in capsys.readouterr().out
    with pytest.raises(ValueError):
        TextSink("odd").execute(df)
    assert "╒" in capsys.readouterr().out
    with pytest.raises(ValueError):
        formatted(df, "csv", most=2)
    with pytest.raises(ValueError):
        with_status(df, ["odd"])
    assert with_status(df, None).count() == 3 and len(HIDDEN) == 11


def test_table_and_file_sinks(spark, tmp_path):
    df = report(spark)
    for _ in range(2):
        TableSink(table="concord_results", statuses=["fail"]).execute(df)
        TableSink(path=f"{tmp_path}/out", kind="csv").execute(df)
    assert spark.table("concord_results").count() == 4 and spark.read.csv(f"{tmp_path}/out").count() == 6
    with pytest.raises(RuntimeError, match="extra"):
        TableSink(table="concord_results").execute(df.selectExpr("*", "1 AS extra"))
    with pytest.raises(ValueError):
        TableSink()
    assert isinstance(sink(None, "csv", None, "Schema"), TextSink) and isinstance(sink({"type": "Files", "path": "p"}), TableSink) and isinstance(sink({"type": "Table", "table": "t"}), TableSink)
    bq = sink({"type": "BigQuery", "table_id": "d.t", "project_id": "p", "google_service_account_key_path": "k"})
    assert isinstance(bq, BigQuerySink) and bq.options["table"] == "p.d.t" and bq.options["credentialsFile"] == "k"
    with pytest.raises(ValueError):
        sink({"type": "Odd"})


# Arguments


def test_tables():
    assert table_mappings("s.t=s2.t2,u.v") == [{"schema_name": "s", "table_name": "t", "target_schema_name": "s2", "target_table_name": "t2"}, {"schema_name": "u", "table_name": "v"}]
    assert table_mappings("s.t=t2") == [{"schema_name": "s", "table_name": "t", "target_table_name": "t2"}] and table_mappings("t", files=True) == [{"schema_name": None, "table_name": "t"}]
    assert table_reference('"my.schema".t') == ("my.schema", "t") and table_reference("a.b.c") == ("a.b", "c")
    assert table_mappings('[{"schema_name": "a", "table_name": "b"}]') == [{"schema_name": "a", "table_name": "b"}] and table_mappings(None) == [{}]
    for bad in ("t", "a.b=c.d=e.f"):
        with pytest.raises(ValueError):
            table_mappings(bad)


def test_filters_of_text():
    of = lambda text: [(f.source, f.target) for f in filters(text)]
    assert of("x > 1") == [("x > 1", "x > 1")] and of("x > 1:y > 2") == [("x > 1", "y > 2")] and of("t = '12:30'") == [("t = '12:30'", "t = '12:30'")]
    assert of("t = '1:2':u = '3:4'") == [("t = '1:2'", "u = '3:4'")]
    for bad in ("", ":", "a:", ":b", "a:b:c", "x = 'open"):
        with pytest.raises(cli.argparse.ArgumentTypeError):
            filters(bad)


def test_other_texts():
    assert labels("a=b,c=d") == [("a", "b"), ("c", "d")] and labels(None) == [] and names("a,b") == ["a", "b"] == names('["a", "b"]') and names(None, []) == []
    assert threshold("1.5") == 1.5 and positive("3") == 3 and statuses(None) is None and statuses("fail") == ["fail"]
    assert result_handler("p.d.t", "k") == {"type": "BigQuery", "project_id": "p", "table_id": "d.t", "google_service_account_key_path": "k"}
    for call, bad in ((labels, "a"), (labels, "a=b=c"), (statuses, "odd"), (result_handler, "t")):
        with pytest.raises(ValueError):
            call(bad)
    for call, bad in ((threshold, "-1"), (threshold, "nan"), (threshold, "inf"), (threshold, "x"), (positive, "0")):
        with pytest.raises(cli.argparse.ArgumentTypeError):
            call(bad)


# Command line


@pytest.fixture(scope="module")
def run(spark, files, tmp_path_factory):
    store = ConnectionStore(spark, str(tmp_path_factory.mktemp("conn")))
    for name, kind in (("csv", "csv"), ("json", "json"), ("parquet", "parquet"), ("changed", "parquet")):
        store.create(name, file_connection(files[name], kind))
    return lambda text, *more: cli.main([*text.split(), *more], spark, store)


def rows(capsys):
    return list(json.loads(capsys.readouterr().out).values())


def test_column_command(run, capsys):
    for source in ("csv", "json"):
        run(f"validate column -sc {source} -tc parquet -tbls entries -count guestName -sum entryid -fmt json -l a=b")
        got = {r["validation_name"]: r for r in rows(capsys)}
        assert {n: r["source_agg_value"] for n, r in got.items()} == {"count": "7", "count__length__guestName": "7", "sum__entryid": "28"}
        assert all(r["validation_status"] == "success" and r["labels"] == [{"key": "a", "value": "b"}] for r in got.values())
    run("validate column -sc parquet -tc changed -tbls entries -gc content -fmt json -fs fail -th 10")
    (r,) = rows(capsys)
    assert (r["group_by_columns"], r["source_agg_value"], r["target_agg_value"], r["pct_difference"]) == ('{"content": "z"}', "4", "3", -25.0)


def test_row_commands(run, capsys):
    for option in ("-hash * -mcc 2", "-concat content", "-comp-fields content,guestName", "-hash guestName -ec"):
        run(f"validate row -sc parquet -tc changed -tbls entries -pk entryID -fmt json -fs fail {option}") if "mcc" not in option else None
        if "mcc" not in option:
            assert {r["group_by_columns"] for r in rows(capsys)} == {'{"entryID": "7"}'}
    run("validate row -sc parquet -tc changed -tbls entries -pk entryID -fmt csv -hash * -mcc 2")
    assert capsys.readouterr().out.count("hash__all") >= 14
    run("validate row -sc parquet -tc changed -tbls entries -pk entryID -hash * -rr -rbs 3 -fmt json -filters", "entryID < 6:entryID < 6")
    assert len(rows(capsys)) == 3


def test_schema_and_query_commands(run, capsys, tmp_path):
    (tmp_path / "allow.yaml").write_text("int32: int64\n")
    run(f"validate schema -sc csv -tc json -tbls entries -fmt json -alf {tmp_path}/allow.yaml")
    assert all(r["validation_status"] == "success" for r in rows(capsys))
    run("validate schema -sc csv -tc json -tbls entries -fmt json -fs fail")
    assert [r["source_column_name"] for r in rows(capsys)] == ["entryid"]
    (tmp_path / "q.sql").write_text("SELECT guestName, entryID FROM entries;\n")
    run(f"validate custom-query row -sc parquet -tc changed -pk entryid -hash * -fmt json -fs fail -tqf {tmp_path}/q.sql -sq", "SELECT guestName, entryID FROM entries")
    assert len(rows(capsys)) == 1
    run("validate custom-query column -sc parquet -tc changed -max entryid -fmt json -sq", "SELECT * FROM entries", "-tq", "SELECT * FROM entries;")
    assert {r["validation_name"]: r["target_agg_value"] for r in rows(capsys)} == {"count": "6", "max__entryid": "6"}


def test_configuration_commands(run, capsys, tmp_path, monkeypatch):
    run(f"validate column -sc parquet -tc changed -tbls entries -sum entryID -c {tmp_path}/0000.yaml -fmt json")
    assert capsys.readouterr().out == ""
    run(f"configs run -c {tmp_path}/0000.yaml")
    assert [r["validation_status"] for r in rows(capsys)] == ["fail", "fail"]
    run(f"configs list -cdir {tmp_path}")
    assert capsys.readouterr().out == "0000.yaml\n"
    run(f"configs get -c {tmp_path}/0000.yaml")
    (spec,) = load_specs(parse_document(capsys.readouterr().out, "x.yaml"))
    assert spec.source_conn == "parquet" and [a.alias for a in spec.aggregates] == ["count", "sum__entryid"]
    run(f"validate column -sc parquet -tc changed -tbls entries -cj {tmp_path}/one.json -fmt json")
    run(f"configs run -c {tmp_path}/one.json")
    assert len(rows(capsys)) == 1
    (tmp_path / "0001.yaml").write_text("source: none\ntarget: none\nvalidations:\n- type: Column\n  table_name: x\n")
    run(f"configs run -cdir {tmp_path}")  # the second file's failure is logged
    assert len(rows(capsys)) == 2
    monkeypatch.setenv("JOB_COMPLETION_INDEX", "0")
    run(f"configs run -cdir {tmp_path}/ -kc")
    assert len(rows(capsys)) == 2
    run(f"configs run -c {tmp_path}/0000.yaml -dr")
    plans = json.loads(capsys.readouterr().out)
    assert set(plans) == {"source_query", "target_query"} and "Aggregate" in plans["source_query"]


def test_partition_command(run, capsys, tmp_path):
    run(f"generate-table-partitions -sc parquet -tc changed -tbls entries -pk entryID -hash * -pn 3 -ppf 2 -cdir {tmp_path} -fmt json")
    run(f"configs run -cdir {tmp_path}/entries")
    out = capsys.readouterr().out
    assert out.count('"fail"') == 1 and out.count('"success"') == 6
    run(f"generate-table-partitions -sc parquet -tc changed -pk entryid -hash * -pn 2 -cdir {tmp_path}/q -sq", "SELECT * FROM entries", "-tq", "SELECT * FROM entries")
    (folder,) = (tmp_path / "q").iterdir()
    assert sorted(p.name for p in folder.iterdir()) == ["0000.yaml", "0001.yaml"]
    with pytest.raises(cli.argparse.ArgumentTypeError):
        run(f"generate-table-partitions -sc parquet -tc changed -tbls entries -pk entryID -hash * -pn 10001 -cdir {tmp_path}")


def test_other_commands(run, capsys):
    run("connections add -c new Raw -j", '{"source_type": "Spark"}')
    run("connections add -c pg Postgres --host h --database d")
    run("connections list")
    assert "new: Spark\n" in (out := capsys.readouterr().out) and "pg: Postgres\n" in out
    run("find-tables -sc parquet -tc csv")
    assert json.loads(capsys.readouterr().out) == [{"schema_name": None, "table_name": "entries", "target_schema_name": None, "target_table_name": "entries"}]
    run("query -c parquet -q", "SELECT count(*) FROM entries")
    assert capsys.readouterr().out == "(7,)\n"
    run("beta validate column -sc csv -tc parquet -tbls entries -fmt json")
    assert len(rows(capsys)) == 1


# Service


def test_service(spark, files):
    http = server(Runner(spark), 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def post(path, body):
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}{path}", json.dumps(body).encode(), method="POST")
        return json.loads(urllib.request.urlopen(request).read())

    try:
        config = {"type": "Column", "table_name": "entries", "source_conn": file_connection(files["parquet"], "parquet"), "target_conn": file_connection(files["changed"], "parquet"), "aggregates": [{"field_alias": "n", "source_column": None, "target_column": None, "type": "count"}]}
        (row,) = post("/", {"config": config})
        assert (row["source_agg_value"], row["target_agg_value"], row["validation_status"]) == ("7", "6", "fail")
        assert post("/test", {"a": 1}) == {"a": 1}
        with pytest.raises(urllib.error.HTTPError):
            post("/", {"config": {"type": "Odd"}})
    finally:
        http.shutdown()
        http.server_close()


def test_runner_uses_inline_connections(spark, files):
    spec = ValidationSpec.from_dict({"type": "Schema", "source_conn": file_connection(files["orc"], "orc"), "target_conn": file_connection(files["parquet"], "parquet")})
    assert Runner(spark).report(spec).where("validation_status = 'fail'").count() == 0


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "lines.json").write_text('\n {"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "array.json").write_text('\n  [{"a": 1},\n {"a": 2}]\n')
    for name, n in (("lines", 3), ("array", 2)):
        assert connect(spark, {"source_type": "FileSystem", "table_name": "t", "file_path": str(tmp_path / f"{name}.json"), "file_type": "json"}).table(None, None).count() == n


DERBY = {"source_type": "DB2", "url": "jdbc:derby:memory:concord;create=true", "driver_class": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "partitions": 4}


def test_jdbc_against_an_embedded_engine(spark):
    rows = spark.range(1000).selectExpr("id AS ID", "id % 7 AS G", "CAST(id AS VARCHAR(9)) AS T", "CAST(NULL AS BIGINT) AS E")
    rows.write.format("jdbc").option("url", DERBY["url"]).option("driver", DERBY["driver_class"]).option("dbtable", "APP.ITEMS").mode("overwrite").save()
    c = connect(spark, DERBY)
    assert "APP" in c.schemas() and c.tables("APP") == ["ITEMS"] and c.all_tables(["APP"]) == [("APP", "ITEMS")]
    ranged = c.table("APP", "ITEMS", "id")
    assert ranged.rdd.getNumPartitions() == 4 and ranged.agg({"ID": "sum"}).first()[0] == 499500 and ranged.select("ID").distinct().count() == 1000
    for key in ("t", "e", "none"):  # keys that can't be cut
        assert c.table("APP", "ITEMS", key).rdd.getNumPartitions() == 1
    summed = c.table("APP", "ITEMS").where("G = 3").groupBy().agg({"ID": "max", "G": "count"})
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregates: [" in plan and "MAX(ID)" in plan and "PushedFilters: [G IS NOT NULL, G = 3]" in plan
    assert sorted(summed.first()) == [143, 997] and c.query("SELECT G, COUNT(*) AS N FROM APP.ITEMS GROUP BY G").count() == 7
    listed = Filter("isin", list(range(0, 2500)), list(range(0, 2500)), "ID", "ID")
    for df in (c.table("APP", "ITEMS"), ranged):
        some = filtered(df, (listed,), SOURCE)
        assert some.count() == 1000 and "Join" not in some._jdf.queryExecution().optimizedPlan().toString()
    local = filtered(spark.range(5000).toDF("ID"), (listed,), SOURCE)
    assert local.count() == 2500 and "Join" in local._jdf.queryExecution().optimizedPlan().toString()
    spec = ValidationSpec.from_dict({"type": "Row", "schema_name": "APP", "table_name": "ITEMS", "source_conn": DERBY, "target_conn": DERBY, "primary_keys": [{"source_column": "ID", "target_column": "ID", "field_alias": "id"}], "comparison_fields": [{"source_column": "T", "target_column": "T", "field_alias": "t"}]})
    report = Runner(spark).report(spec)
    assert report.count() == 1000 and report.where("validation_status = 'fail'").count() == 0


def test_options_of_each_engine():
    host = {"host": "h", "user": "u", "password": "p", "database": "d"}
    of = lambda **c: jdbc_options(host | c)
    assert of(source_type="Teradata", logmech="LDAP", json_params='{"tmode": "ANSI"}')["url"] == "jdbc:teradata://h/DBS_PORT=1025,LOGMECH=LDAP,TMODE=ANSI"
    assert "READ UNCOMMITTED" in of(source_type="Teradata", use_no_lock_tables="True")["sessionInitStatement"] and "sessionInitStatement" not in of(source_type="Teradata", use_no_lock_tables="False")
    assert of(source_type="Snowflake", account="a", connect_args={"warehouse": "w"})["url"].endswith("/?db=d&warehouse=w")
    assert of(source_type="MSSQL", query="applicationIntent=ReadOnly&driver=x")["url"].endswith(";applicationIntent=ReadOnly")
    assert of(source_type="Impala", auth_mechanism="GSSAPI", kerberos_service_name="hive", use_ssl="true", ca_cert="/c", timeout=9) == {"url": "jdbc:hive2://h:10000/d;principal=hive/_HOST;ssl=true;sslTrustStore=/c", "driver": "org.apache.hive.jdbc.HiveDriver", "user": "u", "password": "p", "queryTimeout": "9"}
    assert of(source_type="Impala", auth_mechanism="NOSASL", use_http_transport=True, http_path="x")["url"].endswith("/d;auth=noSasl;transportMode=http;httpPath=x")
    assert of(source_type="DB2", driver="my.Driver")["driver"] == "my.Driver"
    for bad in ({"source_type": "Impala", "hdfs_client": "x"}, {"source_type": "Impala", "auth_mechanism": "odd"}, {"source_type": "Postgres", "no_such_option": 1}):
        with pytest.raises(ConnectionFailure):
            of(**bad)

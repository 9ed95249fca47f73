"""Connections: named sources of tables, files and query results, all of them lazy DataFrames."""

from __future__ import annotations

import hashlib
import json
import logging
import math
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.plans.frames import JDBC_CATALOG

#: Directory of stored connections: this variable's value, or the default.
DIRECTORY_VARIABLE, DIRECTORY = "CONCORD_CONN_HOME", "~/.config/concord"
FILE_TYPES = ("csv", "json", "orc", "parquet")

#: Options of each type of connection; those in the second list may be left out.
FIELDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Spark": ((), ("catalog", "database")),
    "FileSystem": (("table_name", "file_path", "file_type"), ("schema", "options")),
    "BigQuery": (("project_id",), ("google_service_account_key_path",)),
    "Spanner": (("project_id", "instance_id", "database_id"), ("google_service_account_key_path",)),
    "Postgres": (("host", "port", "user", "password", "database"), ()),
    "Redshift": (("host", "port", "user", "password", "database"), ()),
    "MySQL": (("host", "port", "user", "password", "database"), ()),
    "Oracle": (("host", "port", "user", "password", "database"), ("url",)),
    "MSSQL": (("host", "port", "user", "password", "database"), ("query", "url")),
    "DB2": (("host", "port", "user", "password", "database"), ("url", "driver")),
    "Teradata": (("host", "port", "user_name", "password"), ("logmech", "use_no_lock_tables", "json_params")),
    "Snowflake": (("user", "password", "account", "database"), ("connect_args",)),
    "Impala": (("host", "port", "database"), ("auth_mechanism", "kerberos_service_name", "use_ssl", "timeout", "ca_cert", "user", "password", "pool_size", "hdfs_client", "use_http_transport", "http_path")),
}
ALL_FIELDS = {x for fields in FIELDS.values() for part in fields for x in part}
#: JDBC: (URL, driver class, default port).
JDBC = {
    "Postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "Redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver", 5439),
    "MySQL": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "Oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver", 1521),
    "MSSQL": ("jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true;trustServerCertificate=true", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "DB2": ("jdbc:db2://{host}:{port}/{database}", "com.ibm.db2.jcc.DB2Driver", 50000),
    "Teradata": ("jdbc:teradata://{host}/DBS_PORT={port}", "com.teradata.jdbc.TeraDriver", 1025),
    "Snowflake": ("jdbc:snowflake://{account}.snowflakecomputing.com/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", 443),
    "Impala": ("jdbc:hive2://{host}:{port}/{database}", "org.apache.hive.jdbc.HiveDriver", 10000),
    "Spanner": ("jdbc:cloudspanner:/projects/{project_id}/instances/{instance_id}/databases/{database_id}", "com.google.cloud.spanner.jdbc.JdbcDriver", 443),
}
DEFAULTS = {"host": "localhost", "database": "default"}


class ConnectionFailure(RuntimeError):
    """A connection that can't be made from its configuration."""


def resolved(config: dict, secrets: Callable[[str], str] | None) -> dict:
    """Options with their values looked up as secrets, where a secret manager is named."""
    if not config.get("secret_manager_type"):
        return dict(config)
    secrets = secrets or secret_manager(config["secret_manager_type"], config.get("secret_manager_project_id"))
    plain = ("source_type", "secret_manager_type", "secret_manager_project_id")
    return {k: v if k in plain else secrets(v) for k, v in config.items()}


def secret_manager(kind: str, project: str | None) -> Callable[[str], str]:
    """Function that looks a value up in a cloud's secret manager; values that name no secret stay as they are."""
    if kind.lower() != "gcp":
        raise ConnectionFailure(f"unknown secret manager: {kind}; give a function that looks secrets up")
    try:
        from google.api_core.exceptions import NotFound
        from google.cloud import secretmanager
    except ImportError as e:
        raise ConnectionFailure("the connection names a secret manager whose client library isn't installed: google-cloud-secret-manager") from e
    client = secretmanager.SecretManagerServiceClient()

    def look_up(value: str) -> str:
        try:
            return client.access_secret_version(name=f"projects/{project}/secrets/{value}/versions/latest").payload.data.decode()
        except (NotFound, ValueError):
            return value

    return look_up


#: Options of every JDBC connection: type, secrets, Spark's own options, and how tables are read.
COMMON = {"source_type", "secret_manager_type", "secret_manager_project_id", "url", "options", "driver_class", "partitions", "fetch_size"}
#: Options of other engines' drivers that mean nothing to a JDBC driver.
REFUSED = {"hdfs_client"}


def yes(value) -> bool:
    return str(value).strip().lower() in ("true", "1", "yes", "y")


def pairs(value) -> dict:
    """Parameters given as a dictionary, its JSON text, or a=b&c=d."""
    if isinstance(value, dict):
        return value
    text = str(value or "").strip()
    return json.loads(text) if text.startswith("{") else dict(x.split("=", 1) for x in text.split("&") if "=" in x)


def engine_options(config: dict) -> tuple[str, dict]:
    """(what goes behind the URL, further JDBC options) for an engine's own options."""
    kind, given = config["source_type"], {k: v for k, v in config.items() if v not in (None, "")}
    if kind == "Teradata":
        more = ({"LOGMECH": given["logmech"]} if "logmech" in given else {}) | {k.upper(): v for k, v in pairs(given.get("json_params")).items()}
        lock = {"sessionInitStatement": "SET SESSION CHARACTERISTICS AS TRANSACTION ISOLATION LEVEL READ UNCOMMITTED"} if yes(given.get("use_no_lock_tables")) else {}
        return "".join(f",{k}={v}" for k, v in more.items()), lock
    if kind == "Snowflake":
        return "".join(f"&{k}={v}" for k, v in pairs(given.get("connect_args")).items()), {}
    if kind == "MSSQL":
        return "".join(f";{k}={v}" for k, v in pairs(given.get("query")).items() if k != "driver"), {}
    if kind == "Spanner":
        return f"?credentials={given['google_service_account_key_path']}" if "google_service_account_key_path" in given else "", {}
    if kind == "Impala":
        mechanism, more = str(given.get("auth_mechanism", "PLAIN")).upper(), {}
        if mechanism == "NOSASL":
            more["auth"] = "noSasl"
        elif mechanism in ("GSSAPI", "KERBEROS"):
            more["principal"] = f"{given.get('kerberos_service_name', 'impala')}/_HOST"
        elif mechanism not in ("PLAIN", "LDAP"):
            raise ConnectionFailure(f"unknown authentication mechanism: {mechanism}")
        if yes(given.get("use_ssl")):
            more["ssl"] = "true"
            if "ca_cert" in given:
                more["sslTrustStore"] = given["ca_cert"]
        if yes(given.get("use_http_transport")):
            more |= {"transportMode": "http", "httpPath": given.get("http_path", "cliservice")}
        return "".join(f";{k}={v}" for k, v in more.items()), {"queryTimeout": given["timeout"]} if "timeout" in given else {}
    return "", {"driver": given["driver"]} if kind == "DB2" and "." in str(given.get("driver", "")) else {}


def jdbc_options(config: dict) -> dict[str, str]:
    """Options of Spark's JDBC reader for a connection."""
    url, driver, port = JDBC[config["source_type"]]
    needed, optional = FIELDS[config["source_type"]]
    if unknown := {k for k, v in config.items() if v is not None} & REFUSED | set(config) - COMMON - {*needed, *optional, "user", "user_name"}:
        if config["source_type"] in FIELDS and (refused := {k for k in unknown if k in REFUSED or k not in ALL_FIELDS}):
            raise ConnectionFailure(f"a {config['source_type']} connection can't take {', '.join(sorted(refused))}")
    given = config.get("url") or ""
    if given.startswith("jdbc:"):
        url = given
    else:
        values = DEFAULTS | {"port": port} | {k: v for k, v in config.items() if v is not None}
        try:
            url = url.format(**values)
        except KeyError as e:
            raise ConnectionFailure(f"a {config['source_type']} connection needs {e.args[0]}") from e
    behind, more = engine_options(config)
    out = {"url": url + behind, "driver": config.get("driver_class") or driver, "user": config.get("user") or config.get("user_name"), "password": config.get("password")} | more
    return {k: str(v) for k, v in (out | (config.get("options") or {})).items() if v is not None}


#: Rows that a JDBC read fetches at once, and tasks that read a table together, unless the connection says otherwise.
FETCH_ROWS, READ_TASKS = 10_000, 32


@dataclass(frozen=True)
class Connection:
    """A source of tables.  ``config`` holds source_type and that type's options."""

    spark: SparkSession
    config: dict

    @property
    def type(self) -> str:
        return self.config["source_type"]

    def table(self, schema: str | None, table: str | None, key: str | None = None) -> DataFrame:
        """A table, or a file connection's file.

        With a ``key`` of numbers or times, a JDBC table is read by ranges of it, in
        several tasks.  Without one it is a table of Spark's JDBC catalog, to which
        filters, aggregates and limits are sent as SQL where the dialect has them.
        """
        if self.type == "FileSystem":
            return read_file(self.spark, self.config["file_path"], self.config["file_type"], self.config.get("schema"), self.config.get("options"))
        name = ".".join(x for x in (self.config.get("catalog"), schema or self.config.get("database") if self.type == "Spark" else schema, table) if x)
        if self.type == "Spark":
            return self.spark.table(name)
        if self.type == "BigQuery":
            return self.bigquery().option("table", f"{self.config['project_id']}.{name}").load()
        return self.ranged(name, key) if key else self.pushed(schema, table)

    def reader(self):
        return self.spark.read.format("jdbc").options(**{"fetchsize": str(self.config.get("fetch_size") or FETCH_ROWS)} | jdbc_options(self.config))

    def ranged(self, name: str, key: str) -> DataFrame:
        """A JDBC table by ranges of a key between its least and greatest value; in one task where the key can't be cut."""
        whole = self.reader().option("dbtable", name).load()
        own = {c.casefold(): c for c in whole.columns}.get(key.casefold())
        kind = whole.schema[own].dataType if own else None
        if not isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType) or "partitionColumn" in jdbc_options(self.config):
            return whole
        low, high = whole.agg(F.min(f"`{own}`").cast("string"), F.max(f"`{own}`").cast("string")).first()
        if low is None:
            return whole
        if isinstance(kind, T.NumericType):
            low, high = (str(math.floor(float(x))) for x in (low, high))
        ranges = {"partitionColumn": own, "lowerBound": low, "upperBound": high, "numPartitions": str(self.config.get("partitions") or READ_TASKS)}
        return self.reader().options(**ranges).option("dbtable", name).load()

    def pushed(self, schema: str | None, table: str | None) -> DataFrame:
        """A table of a JDBC catalog of this session, made for the connection when it is first asked for."""
        options = {"fetchsize": str(self.config.get("fetch_size") or FETCH_ROWS)} | jdbc_options(self.config)
        catalog = JDBC_CATALOG + hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()[:12]
        prefix = f"spark.sql.catalog.{catalog}"
        if self.spark.conf.get(prefix, None) is None:
            self.spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
            for k, v in options.items():
                self.spark.conf.set(f"{prefix}.{k}", v)
        parts = [x for x in (schema, table) if x]
        parts = parts[-1].split(".") if len(parts) == 1 else parts
        return self.spark.table(".".join([catalog, *(f"`{p}`" for p in parts)]))

    def bigquery(self):
        reader = self.spark.read.format("bigquery").option("parentProject", self.config["project_id"])
        key = self.config.get("google_service_account_key_path")
        return reader.option("credentialsFile", key) if key else reader

    def query(self, sql: str) -> DataFrame:
        """A query's result, with lower-case names.  A file connection's file is a view of its table's name."""
        if self.type == "FileSystem":
            self.table(None, None).createOrReplaceTempView(self.config["table_name"])
        if self.type in ("Spark", "FileSystem"):
            df = self.spark.sql(sql)
        elif self.type == "BigQuery":
            df = self.bigquery().option("query", sql).option("viewsEnabled", "true").load()
        else:
            df = self.reader().option("query", sql).load()
        return df.toDF(*[c.lower() for c in df.columns])

    def table_schema(self, schema: str | None, table: str | None) -> T.StructType:
        return self.table(schema, table).schema

    def query_schema(self, sql: str) -> T.StructType:
        """Schema of a query's result; nothing is run."""
        return self.query(sql).schema

    def schemas(self) -> list[str]:
        if self.type == "FileSystem":
            return []
        if self.type == "Spark":
            return [d.name for d in self.spark.catalog.listDatabases()]
        if self.type == "BigQuery":
            return [r[0] for r in self.query("SELECT schema_name FROM INFORMATION_SCHEMA.SCHEMATA").collect()]
        return self.metadata(lambda m: m.getCatalogs() if self.type == "MySQL" else m.getSchemas())

    def tables(self, schema: str) -> list[str]:
        if self.type == "Spark":
            return [t.name for t in self.spark.catalog.listTables(schema) if not t.isTemporary]
        if self.type == "BigQuery":
            return [r[0] for r in self.query(f"SELECT table_name FROM `{schema}`.INFORMATION_SCHEMA.TABLES").collect()]
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.String, 1)
        kinds[0] = "TABLE"
        place = (schema, None) if self.type == "MySQL" else (None, schema)
        return self.metadata(lambda m: m.getTables(*place, "%", kinds), "TABLE_NAME")

    def metadata(self, ask: Callable, column: str | int = 1) -> list[str]:
        """A column of what the driver itself says of its catalog, whatever the engine's own catalog tables."""
        jvm = self.spark._jvm
        options = jdbc_options(self.config)
        scala = jvm.org.apache.spark.api.python.PythonUtils.toScalaMap(options | {"dbtable": "none"})
        given = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(scala)
        link = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).createConnectionFactory(given).apply(-1)
        try:
            found, out = ask(link.getMetaData()), []
            while found.next():
                out.append(found.getString(column))
            return out
        finally:
            link.close()

    def all_tables(self, allowed: Iterable[str] | None = None) -> list[tuple[str | None, str]]:
        """(schema, table) of all tables of the allowed schemas; a schema that can't be listed is passed over with a warning."""
        if self.type == "FileSystem":
            return [(None, self.config["table_name"])]
        out: list[tuple[str | None, str]] = []
        for schema in list(allowed) if allowed else self.schemas():
            try:
                out += [(schema, t) for t in self.tables(schema)]
            except Exception as e:
                logging.warning("schema %s can't be listed: %s", schema, e)
        return out

    def rows(self, sql: str) -> list:
        """All rows of an ad-hoc query."""
        return self.query(sql).collect()


def read_file(spark: SparkSession, path: str, kind: str, schema: str | None = None, options: dict | None = None) -> DataFrame:
    """A CSV (with header), JSON (lines or one array), ORC or Parquet file or folder, its schema given or inferred."""
    if kind not in FILE_TYPES:
        raise ValueError(f"unknown file type: {kind}")
    reader = spark.read.options(**(options or {}))
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=not schema)
    if kind == "json":
        if not (options or {}).get("multiLine"):  # an array spans lines; else each line is a row and files can be cut
            first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").select(F.left("v", F.lit(1))).first()
            reader = reader.option("multiLine", str(first is not None and first[0] == "[").lower())
        return reader.json(path)
    return reader.format(kind).load(path)


def connect(spark: SparkSession, config: dict, secrets: Callable[[str], str] | None = None) -> Connection:
    """Connection of a configuration."""
    config = resolved(config, secrets)
    kind = config.get("source_type")
    if kind not in FIELDS:
        raise ConnectionFailure(f"unknown connection type: {kind}; there are {', '.join(FIELDS)}")
    if kind not in JDBC and (missing := [f for f in FIELDS[kind][0] if config.get(f) is None]):
        raise ConnectionFailure(f"a {kind} connection needs {', '.join(missing)}")
    if kind in JDBC:
        jdbc_options(config)
    return Connection(spark, config)


def config_from_options(kind: str, options: dict) -> dict:
    """Configuration of a type's options as a command line gives them; Raw takes the JSON text of option "json"."""
    if kind == "Raw":
        return json.loads(options["json"])
    needed, optional = FIELDS[kind]
    managers = ("secret_manager_type", "secret_manager_project_id")
    return {"source_type": kind} | {k: options[k] for k in (*managers, *needed, *optional) if options.get(k) is not None}


class ConnectionStore:
    """Connections kept as files "<name>.connection.json" of a folder: a local one, or any that Spark's file systems reach."""

    def __init__(self, spark: SparkSession | None = None, root: str | None = None):
        self.files = Files(spark, os.path.expanduser(root or os.environ.get(DIRECTORY_VARIABLE) or DIRECTORY))

    def create(self, name: str, config: dict) -> None:
        self.files.write(f"{name}.connection.json", json.dumps(config))

    def get(self, name: str) -> dict:
        return json.loads(self.files.read(f"{name}.connection.json"))

    def names(self) -> list[str]:
        end = ".connection.json"
        return sorted(f.removesuffix(end) for f in self.files.names() if f.endswith(end))


class Files:
    """Text files of one folder: local paths directly, URIs through Hadoop's file systems."""

    def __init__(self, spark: SparkSession | None, root: str):
        self.spark, self.root = spark, root.rstrip("/") or "/"
        self.remote = "://" in root

    def hadoop(self, name: str):
        if self.spark is None:
            raise ValueError(f"{self.root} is read through Spark; there is no session")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self, name: str) -> str:
        if not self.remote:
            return (Path(self.root) / name).read_text()
        fs, path = self.hadoop(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        if not self.remote:
            path = Path(self.root) / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
            return
        fs, path = self.hadoop(name)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self) -> list[str]:
        if not self.remote:
            return sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []
        fs, path = self.hadoop("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

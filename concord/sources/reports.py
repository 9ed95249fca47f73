"""Where reports go: text in four formats, and tables or files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.plans.spec import FORMATS, SCHEMA, STATUSES

#: Columns that the formats table and text leave out.
HIDDEN = ("aggregation_type", "end_time", "labels", "pct_threshold", "start_time", "target_table_name", "target_column_name", "difference", "primary_keys", "group_by_columns", "num_random_rows")
HIDDEN_OF_SCHEMAS = ("start_time", "end_time", "aggregation_type", "difference", "primary_keys", "group_by_columns", "num_random_rows", "pct_threshold")
#: Most rows that are printed; larger reports are written.
PRINTED_ROWS = 100_000


def with_status(report: DataFrame, statuses: Iterable[str] | None) -> DataFrame:
    """Rows of some statuses; None means all."""
    if statuses is None:
        return report
    statuses = list(statuses)
    if bad := [s for s in statuses if s not in STATUSES]:
        raise ValueError(f"unknown status: {bad}")
    return report.where(F.col("validation_status").isin(statuses))


def text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return "; ".join(f"{x['key']}={x['value']}" for x in value)
    return str(value)


def formatted(report: DataFrame, kind: str = "table", hidden: Iterable[str] = HIDDEN, most: int = PRINTED_ROWS) -> str:
    """A report of ``most`` rows at most as text, in the format ``kind``; unknown formats are as table."""
    hide = set(hidden) if kind not in ("csv", "json") else set()
    names = [c for c in report.columns if c not in hide]
    rows = report.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows isn't printed; write it, or keep failures only")
    if kind == "json":
        return json.dumps({str(i): r.asDict(recursive=True) for i, r in enumerate(rows)}, default=str)
    if kind == "csv":
        import csv
        import io

        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(names)
        writer.writerows([text(v) for v in r] for r in rows)
        return out.getvalue()
    cells = [names, *[[text(v) for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    lines = [[x.ljust(w) for x, w in zip(r, widths, strict=True)] for r in cells]
    if kind == "text":
        return "\n".join("  ".join(x) for x in lines)
    rule = lambda a, b, c: a + b.join("═" * (w + 2) for w in widths) + c
    body = ["│ " + " │ ".join(x) + " │" for x in lines]
    return "\n".join([rule("╒", "╤", "╕"), body[0], rule("╞", "╪", "╡"), *body[1:], rule("╘", "╧", "╛")])


class TextSink:
    """Prints reports."""

    def __init__(self, kind: str = "table", statuses: Iterable[str] | None = None, hidden: Iterable[str] = HIDDEN):
        self.kind, self.statuses, self.hidden = kind, statuses, hidden

    def execute(self, report: DataFrame) -> DataFrame:
        report = with_status(report, self.statuses)
        print(formatted(report, self.kind, self.hidden))
        if self.kind not in FORMATS:
            raise ValueError(f"unknown format {self.kind}, printed as table; there are {', '.join(FORMATS)}")
        return report


class TableSink:
    """Appends reports to a table, or to files of a folder."""

    def __init__(self, table: str | None = None, path: str | None = None, kind: str = "parquet", statuses: Iterable[str] | None = None):
        if (table is None) == (path is None):
            raise ValueError("a report goes to a table or to a path")
        self.table, self.path, self.kind, self.statuses = table, path, kind, statuses

    def execute(self, report: DataFrame) -> DataFrame:
        report = with_status(report, self.statuses)
        out = report
        if self.kind == "csv":  # no arrays there
            out = out.withColumn("labels", F.to_json("labels"))
        writer = out.write.mode("append").format(self.kind)
        if self.path:
            writer.save(self.path)
            return report
        spark = report.sparkSession
        if spark.catalog.tableExists(self.table) and (missing := set(out.columns) - set(spark.table(self.table).columns)):
            raise RuntimeError(f"table {self.table} has no column {', '.join(sorted(missing))}: add it, or name another table")
        writer.saveAsTable(self.table)
        return report


class BigQuerySink:
    """Appends reports to a BigQuery table, by the connector (an external jar)."""

    def __init__(self, table: str, project: str, key: str | None = None, statuses: Iterable[str] | None = None):
        self.options = {"table": f"{project}.{table}", "parentProject": project, "writeMethod": "direct"} | ({"credentialsFile": key} if key else {})
        self.statuses = statuses

    def execute(self, report: DataFrame) -> DataFrame:
        report = with_status(report, self.statuses)
        try:
            report.write.format("bigquery").options(**self.options).mode("append").save()
        except Exception as e:
            if "schema" in str(e).lower() or "field" in str(e).lower():
                columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema.fields)
                raise RuntimeError(f"table {self.options['table']} can't take the report; add the columns that it lacks, of: {columns}") from e
            raise
        return report


def sink(handler: dict | None, kind: str = "table", statuses: Iterable[str] | None = None, validation_type: str = ""):
    """Sink of a configuration: none prints; types are BigQuery, Table and Files."""
    if not handler:
        return TextSink(kind, statuses, HIDDEN_OF_SCHEMAS if validation_type == SCHEMA else HIDDEN)
    if handler.get("type") == "BigQuery":
        return BigQuerySink(handler["table_id"], handler["project_id"], handler.get("google_service_account_key_path"), statuses)
    if handler.get("type") == "Table":
        return TableSink(table=handler["table"], statuses=statuses)
    if handler.get("type") == "Files":
        return TableSink(path=handler["path"], kind=handler.get("format", "parquet"), statuses=statuses)
    raise ValueError(f"unknown result handler: {handler.get('type')}")

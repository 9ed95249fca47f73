"""Running validations: connections, the two sides, a report, and where it goes."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.operators.compare import RunInfo
from concord.operators.validate import validate
from concord.plans.frames import SOURCE, TARGET, side_frame
from concord.plans.spec import CUSTOM_QUERY, SCHEMA, ValidationSpec, load_specs, parse_document
from concord.sources.connections import Connection, ConnectionStore, Files, connect
from concord.sources.reports import sink

#: Variables with the number of an orchestrator's task, which is that of its file.
TASK_VARIABLES = ("JOB_COMPLETION_INDEX", "CLOUD_RUN_TASK_INDEX")

#: Engines whose limited reads are random by themselves, so that nothing is sorted.
RANDOM_SAMPLES = ("Teradata", "Spanner")


class Runner:
    """Runs specifications with the connections of a store."""

    def __init__(self, spark: SparkSession, store: ConnectionStore | None = None, secrets: Callable[[str], str] | None = None):
        self.spark, self.store, self.secrets = spark, store, secrets

    def connection(self, of: dict | str) -> Connection:
        """A connection given by its configuration or by its stored name."""
        if isinstance(of, str):
            if self.store is None:
                self.store = ConnectionStore(self.spark)
            of = self.store.get(of)
        return connect(self.spark, of, self.secrets)

    def sides(self, spec: ValidationSpec) -> tuple[DataFrame, DataFrame]:
        """Source and target of a specification, before its filters."""
        source, target = self.connection(spec.source_conn), self.connection(spec.target_conn)
        if spec.type == CUSTOM_QUERY:
            return source.query(spec.source_query), target.query(spec.target_query)
        schema = spec.target_schema_name or spec.schema_name
        keys = spec.primary_keys[0] if spec.primary_keys else None  # rows are read by ranges of a key
        return source.table(spec.schema_name, spec.table_name, keys and keys.source), target.table(schema, spec.target_table_name or spec.table_name, keys and keys.target)

    def report(self, spec: ValidationSpec, run: RunInfo | None = None) -> DataFrame:
        order = not spec.use_random_rows or self.connection(spec.source_conn).type not in RANDOM_SAMPLES
        return validate(*self.sides(spec), spec, run, order=order)

    def execute(self, spec: ValidationSpec) -> DataFrame:
        """Report of a specification, given to its sink; those rows that the sink kept."""
        return sink(spec.result_handler, spec.format, spec.filter_status, spec.type).execute(self.report(spec))

    def plans(self, spec: ValidationSpec) -> dict[str, str]:
        """Optimised plans of both sides; nothing is run."""
        out = {}
        for side, df in zip((SOURCE, TARGET), self.sides(spec), strict=True):
            frame = df if spec.type == SCHEMA else side_frame(df, spec, side)
            out[f"{side}_query"] = frame._jdf.queryExecution().optimizedPlan().toString()
        return out

    def run_all(self, specs: list[ValidationSpec], name: str | None = None, dry_run: bool = False) -> list[DataFrame]:
        """Each specification in turn; one of a file that fails is logged and passed over."""
        out = []
        for spec in specs:
            try:
                if dry_run:
                    print(json.dumps(self.plans(spec), indent=4))
                else:
                    out.append(self.execute(spec))
            except Exception as e:
                if name is None:
                    raise
                logging.error("%s: %s; it is passed over", name, e)
        return out

    def run_file(self, path: str, dry_run: bool = False) -> list[DataFrame]:
        """All validations of a configuration file."""
        folder, name = os.path.split(path)
        return self.run_all(load_specs(parse_document(Files(self.spark, folder or ".").read(name), name)), name, dry_run)

    def run_folder(self, folder: str, numbered: bool = False, dry_run: bool = False) -> list[DataFrame]:
        """All YAML files of a folder; ``numbered``: only that of the task's number, where an orchestrator gives one."""
        if numbered:
            number = next((os.environ[v] for v in TASK_VARIABLES if v in os.environ), None)
            if number is not None:
                return self.run_file(f"{folder.rstrip('/')}/{int(number):04d}.yaml", dry_run)
            logging.warning("no task number is set: all files are run")
        out = []
        for name in Files(self.spark, folder).names():
            if name.endswith(".yaml"):
                out += self.run_file(f"{folder.rstrip('/')}/{name}", dry_run)
        return out

"""Command line: validate, configs, connections, find-tables, query, generate-table-partitions, deploy."""

from __future__ import annotations

import argparse
import json
import logging
import os
import random
import string
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from concord import arguments
from concord.functions.aggregates import AGGREGATES
from concord.operators.match import expand_schemas, match_tables
from concord.operators.partition import MOST_FILES, partition_documents, partition_filters
from concord.operators.schemas import allow_list_text
from concord.plans import expand
from concord.plans.spec import COLUMN, CUSTOM_QUERY, RANDOM_ROWS, ROW, SCHEMA, ValidationSpec, clean_query, dump_specs, format_document, parse_document
from concord.runner import Runner
from concord.sources.connections import FIELDS, ConnectionStore, Files, config_from_options


def common(p: argparse.ArgumentParser, tables: bool = True) -> None:
    p.add_argument("--source-conn", "-sc", required=True)
    p.add_argument("--target-conn", "-tc", required=True)
    p.add_argument("--bq-result-handler", "-bqrh")
    p.add_argument("--service-account", "-sa")
    p.add_argument("--labels", "-l")
    p.add_argument("--config-file", "-c", help="write a YAML file instead of running")
    p.add_argument("--config-file-json", "-cj", help="write a JSON file instead of running")
    p.add_argument("--format", "-fmt", default="table")
    p.add_argument("--filter-status", "-fs")
    p.add_argument("--exact", action="store_true", help="compare decimals as they are")
    p.add_argument("--dry-run", "-dr", action="store_true")
    if tables:
        p.add_argument("--tables-list", "-tbls", required=True)


def queries(p: argparse.ArgumentParser, needed: bool = True) -> None:
    for side, short in (("source", "s"), ("target", "t")):
        g = p.add_mutually_exclusive_group(required=needed)
        g.add_argument(f"--{side}-query", f"-{short}q")
        g.add_argument(f"--{side}-query-file", f"-{short}qf")


def column_options(p: argparse.ArgumentParser, groups: bool) -> None:
    for kind in AGGREGATES:
        p.add_argument(f"--{kind}", f"-{kind}")
    if groups:
        p.add_argument("--grouped-columns", "-gc")
    p.add_argument("--exclude-columns", "-ec", action="store_true")
    p.add_argument("--threshold", "-th", type=arguments.threshold, default=0.0)
    p.add_argument("--filters", "-filters", type=arguments.filters, default=[])
    p.add_argument("--wildcard-include-string-len", "-wis", action="store_true")
    p.add_argument("--wildcard-include-timestamp", "-wit", action="store_true")
    p.add_argument("--cast-to-bigint", "-ctb", action="store_true")


def row_options(p: argparse.ArgumentParser, comparison: bool = True) -> None:
    p.add_argument("--primary-keys", "-pk", required=True)
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--hash", "-hash")
    g.add_argument("--concat", "-concat")
    if comparison:
        g.add_argument("--comparison-fields", "-comp-fields")
    p.add_argument("--threshold", "-th", type=arguments.threshold, default=0.0)
    p.add_argument("--exclude-columns", "-ec", action="store_true")
    p.add_argument("--filters", "-filters", type=arguments.filters, default=[])
    p.add_argument("--trim-string-pks", "-tsp", action="store_true")
    p.add_argument("--case-insensitive-match", "-cim", action="store_true")
    p.add_argument("--max-concat-columns", "-mcc", type=arguments.positive)
    p.add_argument("--use-random-row", "-rr", action="store_true")
    p.add_argument("--random-row-batch-size", "-rbs", type=arguments.positive, default=RANDOM_ROWS)
    p.add_argument("--grouped-columns", "-gc", help="drill down by these groups")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("concord", description=__doc__)
    top.add_argument("--verbose", "-v", action="store_true")
    top.add_argument("--log-level", "-ll", default="INFO")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("validate", "beta"):
        p = sub.add_parser(name)
        inner = p.add_subparsers(dest="validate_cmd" if name == "validate" else "beta_cmd", required=True)
        if name == "beta":
            serve = inner.add_parser("deploy")
            serve.add_argument("--port", type=int, default=int(os.environ.get("PORT", 8080)))
            inner = inner.add_parser("validate").add_subparsers(dest="validate_cmd", required=True)
        column = inner.add_parser("column")
        common(column)
        column_options(column, True)
        row = inner.add_parser("row")
        common(row)
        row_options(row)
        schema = inner.add_parser("schema")
        common(schema)
        schema.add_argument("--exclusion-columns", "-ec")
        schema.add_argument("--allow-list", "-al")
        schema.add_argument("--allow-list-file", "-alf")
        custom = inner.add_parser("custom-query").add_subparsers(dest="custom_query_type", required=True)
        for kind in ("column", "row"):
            p = custom.add_parser(kind)
            common(p, False)
            queries(p)
            column_options(p, False) if kind == "column" else row_options(p)
    parts = sub.add_parser("generate-table-partitions")
    common(parts, False)
    g = parts.add_mutually_exclusive_group(required=True)
    g.add_argument("--tables-list", "-tbls")
    g.add_argument("--source-query", "-sq")
    g.add_argument("--source-query-file", "-sqf")
    g = parts.add_mutually_exclusive_group()
    g.add_argument("--target-query", "-tq")
    g.add_argument("--target-query-file", "-tqf")
    row_options(parts)
    parts.add_argument("--partition-num", "-pn", type=arguments.positive, required=True)
    parts.add_argument("--parts-per-file", "-ppf", type=arguments.positive, default=1)
    parts.add_argument("--config-dir", "-cdir", required=True)
    configs = sub.add_parser("configs").add_subparsers(dest="configs_cmd", required=True)
    run = configs.add_parser("run")
    g = run.add_mutually_exclusive_group(required=True)
    g.add_argument("--config-file", "-c")
    g.add_argument("--config-dir", "-cdir")
    run.add_argument("--kube-completions", "-kc", action="store_true")
    run.add_argument("--dry-run", "-dr", action="store_true")
    configs.add_parser("list").add_argument("--config-dir", "-cdir", default="./")
    configs.add_parser("get").add_argument("--config-file", "-c", required=True)
    connections = sub.add_parser("connections").add_subparsers(dest="connections_cmd", required=True)
    connections.add_parser("list")
    add = connections.add_parser("add")
    add.add_argument("--connection-name", "-c", required=True)
    add.add_argument("--secret-manager-type", "-sm")
    add.add_argument("--secret-manager-project-id", "-sm-prj-id")
    kinds = add.add_subparsers(dest="connect_type", required=True)
    kinds.add_parser("Raw").add_argument("--json", "-j", required=True)
    for kind, (needed, optional) in FIELDS.items():
        p = kinds.add_parser(kind)
        for field in (*needed, *optional):
            p.add_argument(f"--{field.replace('_', '-')}", dest=field)
    find = sub.add_parser("find-tables")
    find.add_argument("--source-conn", "-sc", required=True)
    find.add_argument("--target-conn", "-tc", required=True)
    find.add_argument("--allowed-schemas", "-as")
    find.add_argument("--score-cutoff", "-score", type=float, default=1.0)
    query = sub.add_parser("query")
    query.add_argument("--conn", "-c", required=True)
    query.add_argument("--query", "-q", required=True)
    return top


def query_text(runner: Runner, inline: str | None, path: str | None) -> str:
    if inline:
        return clean_query(inline)
    folder, name = os.path.split(path)
    return clean_query(Files(runner.spark, folder or ".").read(name))


def random_name() -> str:
    """Stands for a table where a query has none."""
    return "custom." + "".join(random.choices(string.ascii_lowercase, k=5))


def specs_from(runner: Runner, args: argparse.Namespace, kind: str) -> list[ValidationSpec]:
    """Specifications of a command line, one for each table pair and chunk of columns."""
    source, target = runner.connection(args.source_conn), runner.connection(args.target_conn)
    files = "FileSystem" in (source.type, target.type)
    mappings = [{}] if kind == CUSTOM_QUERY else expand_schemas(arguments.table_mappings(args.tables_list, files), source.all_tables, target.all_tables)
    handler = arguments.result_handler(args.bq_result_handler, args.service_account) if args.bq_result_handler else None
    out: list[ValidationSpec] = []
    for m in mappings:
        base = ValidationSpec.from_dict(
            {k: v for k, v in m.items() if v is not None},
            type=kind,
            source_conn=args.source_conn,
            target_conn=args.target_conn,
            labels=tuple(arguments.labels(args.labels)),
            threshold=getattr(args, "threshold", 0.0),
            filters=tuple(getattr(args, "filters", ())),
            format=args.format,
            filter_status=None if args.filter_status is None else tuple(arguments.statuses(args.filter_status)),
            result_handler=handler,
            exact=args.exact,
        )
        if kind == CUSTOM_QUERY:
            text = {f"{side}_query": query_text(runner, getattr(args, f"{side}_query"), getattr(args, f"{side}_query_file")) for side in ("source", "target")}
            base = replace(base, custom_query_type=args.custom_query_type, **text)
        s, t = (df.schema for df in runner.sides(base))
        if kind == SCHEMA:
            document = parse_document(Files(runner.spark, os.path.dirname(args.allow_list_file) or ".").read(os.path.basename(args.allow_list_file)), args.allow_list_file) if args.allow_list_file else None
            exclude = tuple(c.casefold() for c in arguments.names(args.exclusion_columns, []))
            out.append(replace(base, exclusion_columns=exclude, allow_list=allow_list_text(args.allow_list, document)))
        elif base.is_row:
            out += row_specs(args, base, s, t, source.type, target.type)
        else:
            wanted = {a: getattr(args, a) for a in AGGREGATES if getattr(args, a)}
            fields, aggregates = expand.column_validation(s, t, wanted, exclude=args.exclude_columns, string_lengths=args.wildcard_include_string_len, timestamps=args.wildcard_include_timestamp, bigint=args.cast_to_bigint, bigquery="BigQuery" in (source.type, target.type))
            groups = expand.key_pairs(args.grouped_columns, s, t) if getattr(args, "grouped_columns", None) else ()
            out.append(replace(base, calculated_fields=fields, aggregates=aggregates, grouped_columns=groups))
    return out


def row_specs(args: argparse.Namespace, base: ValidationSpec, s, t, source_type: str, target_type: str) -> list[ValidationSpec]:
    keys = expand.key_pairs(args.primary_keys, s, t)
    base = replace(base, primary_keys=keys, trim_string_pks=args.trim_string_pks, case_insensitive_match=args.case_insensitive_match, random_row_batch_size=args.random_row_batch_size)
    base = replace(base, use_random_rows=args.use_random_row)
    if getattr(args, "grouped_columns", None):
        base = replace(base, grouped_columns=expand.key_pairs(args.grouped_columns, s, t))
    if columns := args.comparison_fields:
        fields, pairs = expand.comparison_pairs(columns, s, t, [k.source for k in keys], args.exclude_columns, "Teradata" in (source_type, target_type))
        return [replace(base, calculated_fields=fields, comparison_fields=pairs, aggregates=(expand.COUNT_ROWS,) if base.grouped_columns else ())]
    kind, columns = ("hash", args.hash) if args.hash else ("concat", args.concat)
    listed = list(expand.chosen(s, expand.as_list(columns), args.exclude_columns))
    most = expand.most_columns(args.max_concat_columns, source_type, target_type)
    out = []
    for chunk in expand.column_chunks(listed, most):
        fields, pairs = expand.row_pipeline(kind, chunk, s, t, ignore_case=args.case_insensitive_match)
        out.append(replace(base, **{kind: columns if len(chunk) == len(listed) else ",".join(chunk)}, calculated_fields=fields, comparison_fields=pairs, aggregates=(expand.COUNT_ROWS,) if base.grouped_columns else ()))
    if len(out) > 1:
        logging.info("%s columns make %s validations", len(listed), len(out))
    return out


def write_text(runner: Runner, path: str, text: str) -> None:
    folder, name = os.path.split(path)
    Files(runner.spark, folder or ".").write(name, text)


def validate_command(runner: Runner, args: argparse.Namespace) -> None:
    kind = {"column": COLUMN, "row": ROW, "schema": SCHEMA, "custom-query": CUSTOM_QUERY}[args.validate_cmd]
    specs = specs_from(runner, args, kind)
    if args.config_file:
        document = dump_specs(specs, args.source_conn, args.target_conn, specs[0].result_handler if specs else None)
        write_text(runner, args.config_file, format_document(document, args.config_file))
    elif args.config_file_json:
        if len(specs) != 1:
            raise ValueError("a JSON file holds one validation")
        document = specs[0].to_dict() | {"source_conn": runner.connection(args.source_conn).config, "target_conn": runner.connection(args.target_conn).config}
        write_text(runner, args.config_file_json, format_document(document, args.config_file_json))
    else:
        runner.run_all(specs, dry_run=args.dry_run)


def partitions_command(runner: Runner, args: argparse.Namespace) -> None:
    if -(-args.partition_num // args.parts_per_file) > MOST_FILES:
        raise argparse.ArgumentTypeError(f"more than {MOST_FILES} files: raise --parts-per-file or lower --partition-num")
    if not args.tables_list:
        args.custom_query_type = "row"
    for spec in specs_from(runner, args, ROW if args.tables_list else CUSTOM_QUERY):
        filters = partition_filters(*runner.sides(spec), spec, args.partition_num)
        folder = f"{args.config_dir.rstrip('/')}/{spec.source_table or random_name()}"
        for name, document in partition_documents(spec, filters, args.parts_per_file, args.source_conn, args.target_conn).items():
            write_text(runner, f"{folder}/{name}", format_document(document, name))


def find_command(runner: Runner, args: argparse.Namespace) -> str:
    source, target = runner.connection(args.source_conn), runner.connection(args.target_conn)
    return json.dumps(match_tables(source.all_tables(arguments.names(args.allowed_schemas)), target.all_tables(), args.score_cutoff))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, store: ConnectionStore | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper() if not args.verbose else "DEBUG")
    spark = spark or SparkSession.builder.appName("concord").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = store or ConnectionStore(spark)
    runner = Runner(spark, store)
    if args.command == "connections":
        if args.connections_cmd == "list":
            for name in store.names():
                print(f"{name}: {store.get(name).get('source_type')}")
        else:
            store.create(args.connection_name, config_from_options(args.connect_type, vars(args)))
    elif args.command == "validate" or getattr(args, "beta_cmd", "") == "validate":
        validate_command(runner, args)
    elif args.command == "beta":
        from concord.service import serve

        serve(runner, args.port)
    elif args.command == "generate-table-partitions":
        partitions_command(runner, args)
    elif args.command == "find-tables":
        print(find_command(runner, args))
    elif args.command == "query":
        for row in runner.connection(args.conn).rows(args.query):
            print(tuple(row))
    elif args.configs_cmd == "list":
        print("\n".join(n for n in Files(spark, args.config_dir).names() if n.endswith(".yaml")))
    elif args.configs_cmd == "get":
        print(Files(spark, os.path.dirname(args.config_file) or ".").read(os.path.basename(args.config_file)))
    elif args.config_dir:
        runner.run_folder(args.config_dir, args.kube_completions, args.dry_run)
    else:
        runner.run_file(args.config_file, args.dry_run)


if __name__ == "__main__":
    main(sys.argv[1:])

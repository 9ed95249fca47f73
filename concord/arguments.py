"""Texts of the command line: tables, filters, labels, thresholds and so on."""

from __future__ import annotations

import argparse
import csv
import json
import math

from concord.plans.spec import STATUSES, Filter


def names(text: str | list | None, default=None):
    """A list of comma-separated text or of JSON."""
    if not text:
        return default
    if isinstance(text, list):
        return text
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    return value if isinstance(value, list) else text.split(",")


def table_reference(text: str, needs_schema: bool = True) -> tuple[str | None, str]:
    """(schema, table) of dotted text; parts in double quotes may hold dots."""
    *schema, table = next(csv.reader([text], delimiter=".", quotechar='"'))
    if not schema and needs_schema:
        raise ValueError(f"a table is named with its schema: {text}")
    return ".".join(schema).strip() if schema else None, table.strip()


def table_mappings(text: str | None, files: bool = False) -> list[dict]:
    """Table configurations of text like "s.t=s2.t2,s.u", or of a JSON list."""
    if not text:
        return [{}]
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    if isinstance(value, list) and value:
        return value
    out = []
    for item in next(csv.reader([text])):
        source, *target = item.split("=")
        if len(target) > 1:
            raise ValueError(f"a mapping has one source and one target: {item}")
        schema, table = table_reference(source, not files)
        entry = {"schema_name": schema, "table_name": table}
        if target:
            schema, table = table_reference(target[0], False)
            entry |= ({"target_schema_name": schema} if schema else {}) | {"target_table_name": table}
        out.append(entry)
    return out


def split_outside_quotes(text: str, mark: str) -> list[str]:
    """Pieces between marks that aren't within single quotes."""
    out, own, quoted = [], [], False
    for c in text:
        quoted ^= c == "'"
        if c == mark and not quoted:
            out.append("".join(own))
            own = []
        else:
            own.append(c)
    if quoted:
        raise argparse.ArgumentTypeError(f"a quote in the filter isn't closed: {text}")
    return [*out, "".join(own)]


def filters(text: str) -> list[Filter]:
    """The filter "source" or "source:target"; colons within single quotes belong to it."""
    parts = split_outside_quotes(text, ":")
    if len(parts) > 2:
        raise argparse.ArgumentTypeError(f"a filter has a source and a target at most: {text}")
    if not all(parts):
        raise argparse.ArgumentTypeError("a filter can't be empty")
    return [Filter("custom", parts[0], parts[-1])]


def labels(text: str | None) -> list[tuple[str, str]]:
    out = []
    for item in text.split(",") if text else []:
        key, sign, value = item.partition("=")
        if not sign or "=" in value:
            raise ValueError(f"labels are key=value, separated by commas: {item}")
        out.append((key, value))
    return out


def threshold(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"a threshold is a number: {text}") from None
    if not math.isfinite(value) or value < 0:
        raise argparse.ArgumentTypeError(f"a threshold is a finite number from 0 up: {text}")
    return value


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError(f"a positive number was expected: {text}")
    return value


def result_handler(text: str, key: str | None = None) -> dict:
    """BigQuery table "project.dataset.table" as a configuration."""
    project, dot, table = text.partition(".")
    if not dot:
        raise ValueError(f"results go to project.dataset.table: {text}")
    return {"type": "BigQuery", "project_id": project, "table_id": table} | ({"google_service_account_key_path": key} if key else {})


def statuses(text: str | None) -> list[str] | None:
    if text is None:
        return None
    out = names(text)
    if bad := [x for x in out if x not in STATUSES]:
        raise ValueError(f"unknown status: {', '.join(bad)}")
    return out

"""Matching tables of two catalogs by the similarity of their names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from concord.functions.similarity import jaro


def closest(name: str, others: Iterable[str], cutoff: float = 0.0) -> str | None:
    """The most similar name of at least ``cutoff``; the last one of equals."""
    best, found = cutoff, None
    for other in others:
        if (score := jaro(name, other)) >= best:
            best, found = score, other
    return found


def match_tables(source: Iterable[tuple[str | None, str]], target: Iterable[tuple[str | None, str]], cutoff: float = 1.0) -> list[dict[str, str | None]]:
    """For each (schema, table) of the source its closest one of the target, as table configurations."""
    key = lambda pair: ".".join(x for x in pair if x)
    others = {key(p): p for p in target}
    out = []
    for schema, table in source:
        if (other := closest(key((schema, table)), others, cutoff)) is not None:
            out.append({"schema_name": schema, "table_name": table, "target_schema_name": others[other][0], "target_table_name": others[other][1]})
    return out


def expand_schemas(mappings: Iterable[Mapping], source, target) -> list[dict]:
    """Mappings, with "schema.*" without a target replaced by the tables that both sides have.

    ``source`` and ``target`` give (schema, table) pairs: source(schemas), target().
    """
    out: list[dict] = []
    for m in mappings:
        if m and m.get("schema_name") and m.get("table_name") == "*" and not m.get("target_schema_name") and not m.get("target_table_name"):
            out += match_tables(source([m["schema_name"]]), target())
        else:
            out.append(dict(m))
    return out

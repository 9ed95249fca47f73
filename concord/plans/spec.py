"""Validation specifications: dataclasses read from and written to configuration dictionaries, YAML and JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

# Names and defaults of configurations.
COLUMN, GROUPED_COLUMN, ROW, SCHEMA, CUSTOM_QUERY = "Column", "GroupedColumn", "Row", "Schema", "Custom-query"
TYPES = (COLUMN, GROUPED_COLUMN, ROW, SCHEMA, CUSTOM_QUERY)
STATUSES = ("success", "fail")
FORMATS = ("csv", "json", "table", "text")
RANDOM_ROWS, DRILL_DOWN_ROWS = 10_000, 50_000


@dataclass(frozen=True)
class FieldPair:
    """A source and a target column under one alias, with an optional cast."""

    alias: str
    source: str | None
    target: str | None
    cast: str | None = None

    @classmethod
    def from_dict(cls, d: dict) -> FieldPair:
        return cls(d["field_alias"], d.get("source_column"), d.get("target_column"), d.get("cast"))

    def to_dict(self) -> dict:
        return {"field_alias": self.alias, "source_column": self.source, "target_column": self.target, "cast": self.cast}


@dataclass(frozen=True)
class AggregateField(FieldPair):
    """An aggregate over a pair of columns (none: of rows); ``cast`` is of its result."""

    kind: str = "count"

    @classmethod
    def from_dict(cls, d: dict) -> AggregateField:
        return cls(d["field_alias"], d.get("source_column"), d.get("target_column"), d.get("cast"), d["type"])

    def to_dict(self) -> dict:
        out = super().to_dict() | {"type": self.kind}
        return out if self.cast else {k: v for k, v in out.items() if k != "cast"}


@dataclass(frozen=True)
class CalculatedField:
    """A scalar function over columns or calculated fields of lower depth."""

    alias: str
    source: tuple[str, ...]
    target: tuple[str, ...]
    kind: str
    depth: int = 0
    parameters: dict = field(default_factory=dict)

    FIXED = ("field_alias", "source_calculated_columns", "target_calculated_columns", "type", "depth")

    @classmethod
    def from_dict(cls, d: dict) -> CalculatedField:
        more = {k: v for k, v in d.items() if k not in cls.FIXED}
        more |= more.pop("calc_params", None) or {}
        return cls(d["field_alias"], tuple(d["source_calculated_columns"]), tuple(d["target_calculated_columns"]), d["type"], int(d.get("depth", 0)), more)

    def to_dict(self) -> dict:
        return {"field_alias": self.alias, "source_calculated_columns": list(self.source), "target_calculated_columns": list(self.target), "type": self.kind, "depth": self.depth} | self.parameters


@dataclass(frozen=True)
class Filter:
    """custom: SQL text for each side; equals and isin: a column and a value or values for each side;
    greater_than and less_than: as equals; or: any of ``parts``."""

    kind: str
    source: Any = None
    target: Any = None
    source_column: str | None = None
    target_column: str | None = None
    parts: tuple[Filter, ...] = ()

    KINDS = ("custom", "equals", "isin", "greater_than", "less_than", "or")

    @classmethod
    def from_dict(cls, d: dict) -> Filter:
        kind = d["type"]
        if kind not in cls.KINDS:
            raise ValueError(f"unknown filter type: {kind}")
        if kind == "custom":
            return cls(kind, d["source"], d["target"])
        if kind == "or":
            return cls(kind, parts=tuple(cls.from_dict(x) for x in d["filters"]))
        return cls(kind, d["source_value"], d["target_value"], d["source_column"], d["target_column"])

    def to_dict(self) -> dict:
        if self.kind == "custom":
            return {"type": self.kind, "source": self.source, "target": self.target}
        if self.kind == "or":
            return {"type": self.kind, "filters": [x.to_dict() for x in self.parts]}
        return {"type": self.kind, "source_column": self.source_column, "source_value": self.source, "target_column": self.target_column, "target_value": self.target}


def pairs(value) -> tuple[tuple[str, str], ...]:
    """Labels as pairs, from lists, tuples or a dictionary."""
    return tuple((str(k), str(v)) for k, v in (value.items() if isinstance(value, dict) else value or ()))


@dataclass(frozen=True)
class ValidationSpec:
    """One validation of a source against a target.  ``exact`` compares decimals as they are, not as rounded floats."""

    type: str
    source_conn: dict | str | None = None
    target_conn: dict | str | None = None
    schema_name: str | None = None
    table_name: str | None = None
    target_schema_name: str | None = None
    target_table_name: str | None = None
    aggregates: tuple[AggregateField, ...] = ()
    calculated_fields: tuple[CalculatedField, ...] = ()
    grouped_columns: tuple[FieldPair, ...] = ()
    primary_keys: tuple[FieldPair, ...] = ()
    comparison_fields: tuple[FieldPair, ...] = ()
    filters: tuple[Filter, ...] = ()
    threshold: float = 0.0
    use_random_rows: bool = False
    random_row_batch_size: int = RANDOM_ROWS
    trim_string_pks: bool = False
    case_insensitive_match: bool = False
    hash: str | None = None
    concat: str | None = None
    limit: int | None = None
    max_recursive_query_size: int = DRILL_DOWN_ROWS
    custom_query_type: str | None = None
    source_query: str | None = None
    target_query: str | None = None
    exclusion_columns: tuple[str, ...] = ()
    allow_list: str = ""
    labels: tuple[tuple[str, str], ...] = ()
    filter_status: tuple[str, ...] | None = None
    format: str = "table"
    result_handler: dict | None = None
    exact: bool = False

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown validation type: {self.type}")
        if self.filter_status and (bad := set(self.filter_status) - set(STATUSES)):
            raise ValueError(f"unknown status: {sorted(bad)}")
        if self.use_random_rows and not self.primary_keys:
            raise ValueError("random rows need a primary key")

    @property
    def is_row(self) -> bool:
        """Whether values are compared row by row."""
        return self.type == ROW or self.type == CUSTOM_QUERY and (self.custom_query_type or "").lower() == "row"

    @property
    def source_table(self) -> str:
        return ".".join(x for x in (self.schema_name, self.table_name) if x)

    @property
    def target_table(self) -> str:
        schema = self.target_schema_name or self.schema_name
        return ".".join(x for x in (schema, self.target_table_name or self.table_name) if x)

    def with_filter(self, *filters: Filter) -> ValidationSpec:
        return replace(self, filters=self.filters + filters)

    LISTS = {"aggregates": AggregateField, "calculated_fields": CalculatedField, "grouped_columns": FieldPair, "primary_keys": FieldPair, "comparison_fields": FieldPair, "filters": Filter}
    OLD_NAMES = {"source_conn_name": "source_conn", "target_conn_name": "target_conn", "result_handler_config": "result_handler"}

    @classmethod
    def from_dict(cls, d: dict, **more) -> ValidationSpec:
        """From a configuration dictionary; keys of no meaning here are passed over."""
        merged = dict(more)
        for k, v in d.items():
            name = cls.OLD_NAMES.get(k, k)
            if name in cls.__dataclass_fields__ and v is not None and (k == name or not merged.get(name)):  # an inline connection wins over a name
                merged[name] = v
        for name, kind in cls.LISTS.items():
            if name in merged:
                merged[name] = tuple(kind.from_dict(x) if isinstance(x, dict) else x for x in merged[name] or ())
        for name in ("exclusion_columns", "filter_status"):
            if merged.get(name) is not None:
                merged[name] = tuple(merged[name])
        for name in ("source_query", "target_query"):
            if name in merged:
                merged[name] = clean_query(merged[name])
        merged["labels"] = pairs(merged.get("labels"))
        if "threshold" in merged:
            merged["threshold"] = float(merged["threshold"])
        return cls(**merged)

    def to_dict(self) -> dict:
        """Configuration dictionary; defaults are left out."""
        out: dict[str, Any] = {}
        for name, f in self.__dataclass_fields__.items():
            value = getattr(self, name)
            if name == "type" or value != f.default:
                out[name] = [x.to_dict() for x in value] if name in self.LISTS else [list(x) for x in value] if name == "labels" else list(value) if isinstance(value, tuple) else value
        return out


def clean_query(text: str) -> str:
    """SQL text without what ends it; empty text is an error."""
    text = (text or "").strip().rstrip(";\n").strip()
    if not text:
        raise ValueError("a SQL query was expected; it is empty")
    return text


def load_specs(document: dict) -> list[ValidationSpec]:
    """Specifications of a YAML document {source, target, result_handler, validations} or a JSON one with one validation."""
    if "validations" not in document:
        return [ValidationSpec.from_dict(document)]
    common = {"source_conn": document.get("source"), "target_conn": document.get("target"), "result_handler": document.get("result_handler") or None}
    return [ValidationSpec.from_dict(v, **common) for v in document["validations"]]


def dump_specs(specs: list[ValidationSpec], source: str | None, target: str | None, result_handler: dict | None = None) -> dict:
    """YAML document of specifications that share their connections."""
    blocks = []
    for spec in specs:
        block = spec.to_dict()
        for name in ("source_conn", "target_conn", "result_handler"):
            block.pop(name, None)
        blocks.append(block)
    return {"source": source, "target": target, "result_handler": result_handler or {}, "validations": blocks}


def parse_document(text: str, name: str) -> dict:
    """Document of a .yaml or .json file."""
    if name.endswith((".yaml", ".yml")):
        import yaml

        class Loader(yaml.SafeLoader):
            """Safe loader that takes tuples, as older files hold them, for lists."""

        Loader.add_constructor("tag:yaml.org,2002:python/tuple", lambda loader, node: loader.construct_sequence(node))
        return yaml.load(text, Loader)
    if name.endswith("json"):
        return json.loads(text)
    raise ValueError(f"a configuration is named *.yaml or *.json: {name}")


def format_document(document: dict, name: str) -> str:
    """Text of a .yaml or .json file."""
    if name.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_dump(document, sort_keys=False)
    if name.endswith("json"):
        return json.dumps(document)
    raise ValueError(f"a configuration is named *.yaml or *.json: {name}")

"""Table schemas and database configurations: the schema files of a database folder."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml

from docframe.errors import DatabaseConfigError, QueryParseError, SchemaInvalidError, SchemaNotFoundError
from docframe.functions.values import DECLARED
from docframe.sources.frontmatter import FrontMatterError, load_yaml

#: Fixed value, part of the file format: the name of schema and configuration files.
SCHEMA_FILE = "_mdql.md"
STAMPS = ("created", "modified")


@dataclass(frozen=True)
class FieldSpec:
    type: str = "string"
    required: bool = False
    enum: tuple[object, ...] = ()


@dataclass(frozen=True)
class SectionSpec:
    type: str = "markdown"
    required: bool = False


@dataclass(frozen=True)
class TableSchema:
    table: str
    fields: dict[str, FieldSpec] = field(default_factory=dict)
    sections: dict[str, SectionSpec] = field(default_factory=dict)
    primary_key: str = "path"
    h1_required: bool = True
    #: The front-matter field that the H1 must equal.
    h1_field: str | None = None
    reject_unknown_frontmatter: bool = True
    reject_unknown_sections: bool = True
    reject_duplicate_sections: bool = True
    normalize_numbered_headings: bool = False

    @property
    def is_open(self) -> bool:
        return not (self.reject_unknown_frontmatter and self.reject_unknown_sections)


def split_document(text: str) -> tuple[str | None, str, str | None]:
    """(front matter, rest, problem) of a document's text."""
    lines = text.removeprefix("﻿").split("\n")
    if not lines or lines[0].strip() != "---":
        return None, text, "Missing front matter: the first line must be ---"
    for i in range(1, len(lines)):
        if lines[i].strip() == "---":
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :]), None
    return None, text, "Unclosed front matter: no closing ---"


def _front_matter(text: str, what: str, error: type[Exception]) -> dict:
    front, _, problem = split_document(text)
    if problem:
        raise error(f"{what}: {problem}")
    try:
        found = load_yaml(front)
    except FrontMatterError as e:
        raise error(f"{what}: {e}") from None
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise error(f"{what}: front matter must be a mapping")
    return found


def _mapping(value: object, name: str, what: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise SchemaInvalidError(f"{what}: '{name}' must be a mapping")
    return value


def parse_schema(text: str, what: str = "schema") -> TableSchema:
    """The schema that a file's text declares."""
    top = _front_matter(text, what, SchemaInvalidError)
    if top.get("type") != "schema":
        raise SchemaInvalidError(f"{what}: expected 'type: schema'")
    if not isinstance(top.get("table"), str):
        raise SchemaInvalidError(f"{what}: 'table' must be a string")
    fields, sections = {}, {}
    for name, spec in _mapping(top.get("frontmatter"), "frontmatter", what).items():
        spec = _mapping(spec, f"frontmatter.{name}", what)
        kind = spec.get("type", "string")
        if kind not in DECLARED:
            raise SchemaInvalidError(f"{what}: field '{name}' has unknown type '{kind}', expected one of {', '.join(DECLARED)}")
        choices = spec.get("enum") or ()
        if not isinstance(choices, list | tuple):
            raise SchemaInvalidError(f"{what}: enum of '{name}' must be a list")
        fields[str(name)] = FieldSpec(kind, spec.get("required") is True, tuple(choices))
    for name, spec in _mapping(top.get("sections"), "sections", what).items():
        spec = _mapping(spec, f"sections.{name}", what)
        sections[str(name)] = SectionSpec(str(spec.get("type", "markdown")), spec.get("required") is True)
    h1, rules = _mapping(top.get("h1"), "h1", what), _mapping(top.get("rules"), "rules", what)
    flag = lambda name, default: rules[name] if isinstance(rules.get(name), bool) else default
    return TableSchema(
        top["table"],
        fields,
        sections,
        str(top.get("primary_key") or "path"),
        h1.get("required") is not False,
        h1.get("must_equal_frontmatter"),
        flag("reject_unknown_frontmatter", True),
        flag("reject_unknown_sections", True),
        flag("reject_duplicate_sections", True),
        flag("normalize_numbered_headings", False),
    )


def load_schema(folder: str | Path) -> TableSchema:
    path = Path(folder) / SCHEMA_FILE
    if not path.is_file():
        raise SchemaNotFoundError(f"No {SCHEMA_FILE} in {folder}")
    return parse_schema(path.read_text("utf-8"), str(path))


def schema_text(schema: TableSchema, rest: str = "") -> str:
    """A schema as a file; rest is the text after the front matter."""
    top: dict[str, object] = {"type": "schema", "table": schema.table, "primary_key": schema.primary_key}
    top["frontmatter"] = {
        k: {"type": f.type, "required": f.required} | ({"enum": list(f.enum)} if f.enum else {}) for k, f in schema.fields.items()
    }
    top["h1"] = {"required": schema.h1_required} | ({"must_equal_frontmatter": schema.h1_field} if schema.h1_field else {})
    top["sections"] = {k: {"type": s.type, "required": s.required} for k, s in schema.sections.items()}
    top["rules"] = {
        k: getattr(schema, k)
        for k in ("reject_unknown_frontmatter", "reject_unknown_sections", "reject_duplicate_sections", "normalize_numbered_headings")
    }
    return f"---\n{yaml.safe_dump(top, sort_keys=False, allow_unicode=True)}---\n{rest}"


def renamed(schema: TableSchema, old: str, new: str) -> TableSchema:
    """The schema with a field or section renamed in its place."""
    swap = lambda d: {new if k == old else k: x for k, x in d.items()}
    h1 = new if schema.h1_field == old and old in schema.fields else schema.h1_field
    return replace(schema, fields=swap(schema.fields), sections=swap(schema.sections), h1_field=h1)


def without(schema: TableSchema, *names: str) -> TableSchema:
    keep = lambda d: {k: x for k, x in d.items() if k not in names}
    return replace(schema, fields=keep(schema.fields), sections=keep(schema.sections), h1_field=None if schema.h1_field in names else schema.h1_field)


@dataclass(frozen=True)
class ForeignKey:
    from_table: str
    from_column: str
    to_table: str
    to_column: str


@dataclass(frozen=True)
class View:
    name: str
    query: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class DatabaseConfig:
    name: str
    foreign_keys: tuple[ForeignKey, ...] = ()
    views: tuple[View, ...] = ()
    #: The file's text after the front matter.
    rest: str = ""


def is_database(folder: str | Path) -> bool:
    """Whether the folder's file declares a database."""
    path = Path(folder) / SCHEMA_FILE
    if not path.is_file():
        return False
    front, _, problem = split_document(path.read_text("utf-8"))
    if problem:
        return False
    try:
        top = load_yaml(front)
    except FrontMatterError:
        return False
    return isinstance(top, dict) and top.get("type") == "database"


def _reference(value: object, what: str) -> tuple[str, str]:
    table, dot, column = value.partition(".") if isinstance(value, str) else ("", "", "")
    if not (table and dot and column):
        raise DatabaseConfigError(f"{what}: expected 'table.column', got {value!r}")
    return table, column


def load_database_config(folder: str | Path) -> DatabaseConfig:
    path = Path(folder) / SCHEMA_FILE
    if not path.is_file():
        raise DatabaseConfigError(f"No {SCHEMA_FILE} in {folder}")
    text = path.read_text("utf-8")
    top = _front_matter(text, str(path), DatabaseConfigError)
    if top.get("type") != "database":
        raise DatabaseConfigError(f"{path}: expected 'type: database'")
    if not isinstance(top.get("name"), str):
        raise DatabaseConfigError(f"{path}: 'name' must be a string")
    keys, views = [], []
    for entry in top.get("foreign_keys") or ():
        if not isinstance(entry, dict):
            raise DatabaseConfigError(f"{path}: a foreign key must be a mapping with 'from' and 'to'")
        keys.append(ForeignKey(*_reference(entry.get("from"), str(path)), *_reference(entry.get("to"), str(path))))
    for entry in top.get("views") or ():
        if not isinstance(entry, dict) or not isinstance(entry.get("name"), str) or not isinstance(entry.get("query"), str):
            raise DatabaseConfigError(f"{path}: a view must be a mapping with 'name' and 'query'")
        views.append(View(entry["name"], entry["query"], tuple(entry.get("columns") or ())))
    return DatabaseConfig(top["name"], tuple(keys), tuple(views), split_document(text)[1])


def config_text(config: DatabaseConfig) -> str:
    top: dict[str, object] = {"type": "database", "name": config.name}
    if config.foreign_keys:
        top["foreign_keys"] = [{"from": f"{k.from_table}.{k.from_column}", "to": f"{k.to_table}.{k.to_column}"} for k in config.foreign_keys]
    if config.views:
        top["views"] = [{"name": v.name, "query": v.query} | ({"columns": list(v.columns)} if v.columns else {}) for v in config.views]
    return f"---\n{yaml.safe_dump(top, sort_keys=False, allow_unicode=True)}---\n{config.rest}"


def checked_view(view: View) -> None:
    """Raises QueryParseError unless the view's query is a SELECT."""
    from docframe.plans import tree
    from docframe.plans.parser import parse

    if not isinstance(parse(view.query), tree.Select):
        raise QueryParseError(f"View '{view.name}' must be a SELECT")

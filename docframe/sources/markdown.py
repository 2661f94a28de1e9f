"""Documents: parsing, validation and typing of one Markdown file. No Spark here."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from docframe.functions.values import display_text
from docframe.sources.frontmatter import FrontMatterError, load_yaml
from docframe.sources.schema import STAMPS, FieldSpec, TableSchema, split_document

_H1 = re.compile(r"#\s+(.+)$")
_H2 = re.compile(r"##\s+(.+)$")
_FENCE = re.compile(r"(`{3,}|~{3,})(.*)$")
_NUMBERED = re.compile(r"\d+\.\s+")
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")
_TIME = re.compile(r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?")


def normalize_heading(text: str) -> str:
    """A heading without a leading number."""
    return _NUMBERED.sub("", text, count=1) if _NUMBERED.match(text) else text


@dataclass
class Section:
    heading: str
    name: str
    body: str
    line: int


@dataclass
class Document:
    path: str
    front: dict = field(default_factory=dict)
    h1: str | None = None
    h1_line: int | None = None
    sections: list[Section] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Problem:
    file_path: str
    error_type: str
    field: str | None
    message: str
    line_number: int | None = None


def parse_document(text: str, path: str, normalize: bool = False) -> Document:
    """Parses a document; what is wrong is collected in problems, nothing is raised."""
    doc = Document(path)
    text = text.replace("\r\n", "\n")
    front, rest, problem = split_document(text)
    first = 1
    if problem:
        doc.problems.append(problem)
    else:
        first = text.count("\n") - rest.count("\n") + 1
        try:
            top = load_yaml(front) if front.strip() else {}
            if top is None:
                top = {}
            if isinstance(top, dict):
                doc.front = {k if isinstance(k, str) else display_text(k): v for k, v in top.items()}
            else:
                doc.problems.append("Front matter must be a mapping")
        except FrontMatterError as e:
            doc.problems.append(f"Malformed YAML in front matter: {e}")
    _read_body(doc, rest, first, normalize)
    return doc


def _read_body(doc: Document, text: str, first: int, normalize: bool) -> None:
    fence, body = "", None
    for number, line in enumerate(text.split("\n"), first):
        mark = _FENCE.match(line.strip())
        if fence:
            closes = mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip()
            fence = "" if closes else fence
        elif mark:
            fence = mark[1]
        elif m := _H2.match(line):
            heading = m[1].strip()
            body = []
            doc.sections.append(Section(heading, normalize_heading(heading) if normalize else heading, "", number))
            doc.sections[-1].body = body  # type: ignore[assignment]
            continue
        elif m := _H1.match(line):
            if doc.h1 is None:
                doc.h1, doc.h1_line = m[1].strip(), number
            else:
                doc.problems.append(f"Second H1 in line {number}")
            continue
        if body is not None:
            body.append(line)
    for s in doc.sections:
        s.body = "\n".join(s.body).strip()


def parse_date(text: object) -> dt.date | None:
    if not isinstance(text, str) or not _DATE.fullmatch(text):
        return None
    try:
        return dt.date(*map(int, text.split("-")))
    except ValueError:
        return None


def parse_time(text: object) -> dt.datetime | None:
    if not isinstance(text, str) or not _TIME.fullmatch(text):
        return None
    day, clock = text.split("T")
    clock, _, fraction = clock.partition(".")
    try:
        d = dt.date(*map(int, day.split("-")))
        h, m, s = map(int, clock.split(":"))
        return dt.datetime(d.year, d.month, d.day, h, m, s, int((fraction + "000000")[:6]))
    except ValueError:
        return None


def _kind(value: object) -> str:
    return {bool: "bool", int: "int", float: "float", str: "string", list: "list", dict: "mapping"}.get(type(value), type(value).__name__)


def type_problem(value: object, kind: str) -> str | None:
    """What keeps a YAML value from being of a declared type; null always passes."""
    if value is None:
        return None
    match kind:
        case "string":
            ok = isinstance(value, str)
        case "int":
            ok = isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 64
        case "float":
            ok = isinstance(value, int | float) and not isinstance(value, bool)
        case "bool":
            ok = isinstance(value, bool)
        case "date":
            return None if parse_date(value) else f"expected date (YYYY-MM-DD), got {display_text(value)!r}"
        case "datetime":
            return None if parse_time(value) else f"expected datetime (YYYY-MM-DDTHH:MM:SS), got {display_text(value)!r}"
        case "string[]":
            if isinstance(value, list):
                for i, x in enumerate(value):
                    if not isinstance(x, str):
                        return f"expected string[], item {i} is {_kind(x)}"
                return None
            ok = False
        case _:
            if isinstance(value, dict):
                for k, x in value.items():
                    if isinstance(x, list | dict):
                        return f"expected dict of plain values, '{k}' is {_kind(x)}"
                return None
            ok = False
    return None if ok else f"expected {kind}, got {_kind(value)}"


def validate_document(doc: Document, schema: TableSchema) -> list[Problem]:
    """Every way in which a document breaks its schema. A document that does not parse has no other."""
    path = doc.path
    if doc.problems:
        return [Problem(path, "parse_error", None, p) for p in doc.problems]
    found: list[Problem] = []
    for name, spec in schema.fields.items():
        if name not in doc.front:
            if spec.required:
                found.append(Problem(path, "missing_field", name, f"Missing required field '{name}'"))
            continue
        found += _field_problems(path, name, doc.front[name], spec)
    for name in STAMPS:
        declared = schema.fields.get(name)
        if name in doc.front and not (declared and declared.type == "datetime"):
            if reason := type_problem(doc.front[name], "datetime"):
                found.append(Problem(path, "type_mismatch", name, f"Field '{name}': {reason}"))
    if schema.reject_unknown_frontmatter:
        found += [
            Problem(path, "unknown_field", k, f"Unknown field '{k}'") for k in doc.front if k not in schema.fields and k not in STAMPS
        ]
    return found + _heading_problems(doc, schema) + _section_problems(doc, schema)


def _field_problems(path: str, name: str, value: object, spec: FieldSpec) -> list[Problem]:
    if reason := type_problem(value, spec.type):
        return [Problem(path, "type_mismatch", name, f"Field '{name}': {reason}")]
    if spec.enum and value is not None:
        allowed = [display_text(x) for x in spec.enum]
        bad = [x for x in (value if isinstance(value, list) else [value]) if display_text(x) not in allowed]
        if bad:
            return [Problem(path, "enum_violation", name, f"Field '{name}': '{display_text(bad[0])}' is not one of {', '.join(allowed)}")]
    return []


def _heading_problems(doc: Document, schema: TableSchema) -> list[Problem]:
    if doc.h1 is None:
        return [Problem(doc.path, "missing_h1", None, "Missing H1 heading")] if schema.h1_required else []
    if schema.h1_field and (wanted := doc.front.get(schema.h1_field)) is not None and display_text(wanted) != doc.h1:
        text = f"H1 '{doc.h1}' does not match field '{schema.h1_field}' ('{display_text(wanted)}')"
        return [Problem(doc.path, "h1_mismatch", schema.h1_field, text, doc.h1_line)]
    return []


def _section_problems(doc: Document, schema: TableSchema) -> list[Problem]:
    names = [s.name for s in doc.sections]
    found = []
    if schema.reject_duplicate_sections:
        for name in sorted({n for n in names if names.count(n) > 1}):
            found.append(Problem(doc.path, "duplicate_section", name, f"Duplicate section '{name}'"))
    for name, spec in schema.sections.items():
        if spec.required and name not in names:
            found.append(Problem(doc.path, "missing_section", name, f"Missing required section '{name}'"))
    if schema.reject_unknown_sections:
        for s in doc.sections:
            if s.name not in schema.sections:
                found.append(Problem(doc.path, "unknown_section", s.name, f"Unknown section '{s.name}'", s.line))
    return found


def typed_value(value: object, kind: str) -> object:
    """A YAML value as the Python value of a declared type; None where it does not fit."""
    if value is None:
        return None
    match kind:
        case "int":
            return None if not isinstance(value, int) or isinstance(value, bool) else (value + (1 << 63)) % (1 << 64) - (1 << 63)
        case "float":
            return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
        case "bool":
            return value if isinstance(value, bool) else None
        case "date":
            return parse_date(value)
        case "datetime":
            return parse_time(value)
        case "string[]":
            return [x for x in value if isinstance(x, str)] if isinstance(value, list) else None
        case "dict":
            return {str(k): None if x is None else display_text(x) for k, x in value.items()} if isinstance(value, dict) else None
    return value if isinstance(value, str) else display_text(value)


def document_row(doc: Document, schema: TableSchema) -> dict[str, object]:
    """The row of a valid document: declared columns by name, and the two maps of undeclared ones."""
    row: dict[str, object] = {"path": doc.path}
    for name, spec in schema.fields.items():
        row[name] = typed_value(doc.front.get(name), spec.type)
    for name in STAMPS:
        if name not in schema.fields:
            row[name] = parse_time(doc.front.get(name))
    row["h1"] = doc.h1
    bodies = {s.name: s.body for s in doc.sections}
    for name in schema.sections:
        row[name] = bodies.get(name)
    row["_extra"] = {k: None if x is None else display_text(x) for k, x in doc.front.items() if k not in schema.fields and k not in STAMPS}
    row["_sections"] = {k: b for k, b in bodies.items() if k not in schema.sections}
    return row

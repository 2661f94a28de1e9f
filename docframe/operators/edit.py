"""Edits of one document's text that leave the rest of it as it is."""

from __future__ import annotations

import datetime as dt
import json
import re

from docframe.functions.values import display_text
from docframe.sources.markdown import Section, parse_document
from docframe.sources.schema import STAMPS, TableSchema

_NOT_SLUG = re.compile(r"[^\w\s-]")


def slugify(text: str, longest: int = 80) -> str:
    """A file name from a title."""
    words = re.sub(r"[\s_-]+", "-", _NOT_SLUG.sub("", text.lower().strip()))
    return words.strip("-")[:longest].strip("-")


def now_text() -> str:
    return dt.datetime.now().strftime("%Y-%m-%dT%H:%M:%S")


def _quoted(value: object) -> str:
    return json.dumps(display_text(value), ensure_ascii=False)


def yaml_lines(key: str, value: object, kind: str = "string") -> list[str]:
    """The lines of a front-matter key."""
    name = key if re.fullmatch(r"[A-Za-z_][\w-]*", key) else json.dumps(key, ensure_ascii=False)
    if value is None:
        return [f"{name}: null"]
    if isinstance(value, list | tuple):
        return [f"{name}: []"] if not value else [f"{name}:", *(f"  - {_quoted(x)}" for x in value)]
    if isinstance(value, dict):
        if not value:
            return [f"{name}: {{}}"]
        plain = lambda x: display_text(x) if isinstance(x, bool | int | float) else "null" if x is None else _quoted(x)
        return [f"{name}:", *(f"  {json.dumps(str(k), ensure_ascii=False)}: {plain(x)}" for k, x in value.items())]
    if isinstance(value, bool | int | float) and kind != "string":
        text = display_text(value)
        return [f"{name}: {text if kind != 'float' or any(c in text for c in '.einf') else text + '.0'}"]
    return [f"{name}: {_quoted(value)}"]


def _front(text: str) -> tuple[list[str], int] | None:
    """(lines of the text, line of the closing ---), or None without front matter."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return None
    for i in range(1, len(lines)):
        if lines[i].strip() == "---":
            return lines, i
    return None


def _key_block(lines: list[str], end: int, key: str) -> tuple[int, int] | None:
    """Lines [from, to) of a front-matter key with its continuation lines."""
    names = {key, json.dumps(key, ensure_ascii=False), f"'{key}'"}
    for i in range(1, end):
        head, colon, _ = lines[i].partition(":")
        if colon and head.rstrip() in names and not lines[i][:1].isspace():
            to = i + 1
            while to < end and (lines[to][:1] in (" ", "\t") or re.match(r"-\s", lines[to])):
                to += 1
            return i, to
    return None


def set_key(text: str, key: str, value: object, kind: str = "string") -> str:
    """Sets a front-matter key, in its place or at the end."""
    if (found := _front(text)) is None:
        return "\n".join(["---", *yaml_lines(key, value, kind), "---", text])
    lines, end = found
    at = _key_block(lines, end, key) or (end, end)
    lines[at[0] : at[1]] = yaml_lines(key, value, kind)
    return "\n".join(lines)


def rename_key(text: str, old: str, new: str) -> str:
    if (found := _front(text)) is None or (at := _key_block(*found, old)) is None:
        return text
    lines = found[0]
    lines[at[0]] = yaml_lines(new, None)[0].removesuffix(": null") + ":" + lines[at[0]].partition(":")[2]
    return "\n".join(lines)


def drop_key(text: str, key: str) -> str:
    if (found := _front(text)) is None or (at := _key_block(*found, key)) is None:
        return text
    lines = found[0]
    del lines[at[0] : at[1]]
    return "\n".join(lines)


def _sections(text: str, normalize: bool) -> list[tuple[Section, int, int]]:
    """Sections with their lines [from, to) in the text, counted from 0."""
    found = parse_document(text, "", normalize).sections
    stops = [s.line - 1 for s in found[1:]] + [text.count("\n") + 1]
    return [(s, s.line - 1, stop) for s, stop in zip(found, stops, strict=True)]


def rename_section(text: str, old: str, new: str, normalize: bool = False) -> str:
    lines = text.split("\n")
    for s, start, _ in _sections(text, normalize):
        if s.name == old:
            lines[start] = f"## {new}"
    return "\n".join(lines)


def drop_section(text: str, name: str, normalize: bool = False) -> str:
    lines = text.split("\n")
    for s, start, stop in reversed(_sections(text, normalize)):
        if s.name == name:
            last = stop == len(lines)
            while start and not lines[start - 1].strip():
                start -= 1
            lines[start:stop] = [""] if last or stop > start else []
    return "\n".join(lines)


def set_section(text: str, name: str, body: str, normalize: bool = False) -> str:
    """Replaces a section's body, or adds the section at the end."""
    lines = text.split("\n")
    for s, start, stop in _sections(text, normalize):
        if s.name == name:
            lines[start + 1 : stop] = ["", body, ""]
            return "\n".join(lines)
    return text.rstrip("\n") + f"\n\n## {name}\n\n{body}\n"


def merge_sections(text: str, names: list[str], into: str, normalize: bool = False) -> str:
    """Joins the bodies of the named sections, in the order of names, in the first one's place.

    A text that has fewer than two of them is left as it is.
    """
    own = [x for x in _sections(text, normalize) if x[0].name in names]
    if len(own) < 2:
        return text
    lines = text.split("\n")
    bodies = [s.body for n in names for s, _, _ in own if s.name == n and s.body]
    for _, start, stop in reversed(own[1:]):
        del lines[start:stop]
    _, start, stop = own[0]
    lines[start:stop] = [f"## {into}", "", "\n\n".join(bodies), ""]
    return "\n".join(lines)


def stamp(text: str, now: str | None = None, created: object = None) -> str:
    """Sets created if it is missing (or given), and modified. A text without front matter is left as it is."""
    if _front(text) is None:
        return text
    now = now or now_text()
    front = parse_document(text, "").front
    if created is not None or front.get("created") is None:
        text = set_key(text, "created", created or now)
    return set_key(text, "modified", now)


def document_text(data: dict[str, object], schema: TableSchema, body: str | None = None) -> str:
    """A new document: declared fields in the schema's order, other fields, and either body or sections."""
    lines: list[str] = []
    for name, spec in schema.fields.items():
        if name in data and name not in STAMPS:
            lines += yaml_lines(name, data[name], spec.type)
    known = {*schema.fields, *schema.sections, *STAMPS, "h1", "path"}
    for name, value in data.items():
        if name not in known:
            lines += yaml_lines(name, value if isinstance(value, list | dict) else display_text(value))
    text = "\n".join(["---", *lines, "---", ""])
    if body is not None:
        return text + ("" if body.startswith("\n") else "\n") + body + ("" if body.endswith("\n") else "\n")
    title = data.get(schema.h1_field) if schema.h1_field else data.get("h1", data.get("title"))
    if title is not None:
        text += f"\n# {display_text(title)}\n"
    for name, spec in schema.sections.items():
        if data.get(name) is not None or spec.required:
            text += f"\n## {name}\n\n{display_text(data.get(name))}\n"
    return text

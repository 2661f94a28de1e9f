"""Results as text: table, JSON or CSV."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import shutil

from docframe.functions.values import display_text

FORMATS = ("table", "json", "csv")
GAP = "  "


def _json_value(value: object) -> object:
    if isinstance(value, dt.date | dt.datetime):
        return display_text(value)
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    return value


def _cut(text: str, width: int) -> str:
    return text if len(text) <= width else text[: max(0, width - 3)] + "..."


def as_table(rows: list[dict[str, object]], columns: list[str], longest: int = 0, width: int | None = None) -> str:
    """Aligned columns, numbers to the right. longest: characters of a cell at most (0: as fits the terminal)."""
    if not rows:
        return "No results."
    cells = [[" ".join(display_text(r.get(c)).split()) for c in columns] for r in rows]
    if longest:
        cells = [[_cut(x, longest) for x in row] for row in cells]
    sizes = [max(len(c), *(len(row[i]) for row in cells)) for i, c in enumerate(columns)]
    room = (width or shutil.get_terminal_size((120, 24)).columns) - len(GAP) * (len(columns) - 1)
    while sum(sizes) > room and max(sizes) > 8:
        sizes[sizes.index(max(sizes))] -= 1
    right = [isinstance(rows[0].get(c), int | float) and not isinstance(rows[0].get(c), bool) for c in columns]
    line = lambda row: GAP.join((_cut(x, s).rjust(s) if r else _cut(x, s).ljust(s)) for x, s, r in zip(row, sizes, right, strict=True)).rstrip()
    return "\n".join([line(columns), GAP.join("-" * s for s in sizes), *map(line, cells)])


def render(rows: list[dict[str, object]], columns: list[str], kind: str = "table", longest: int = 0) -> str:
    """An empty result is [] in JSON and the header in CSV."""
    if kind == "json":
        return json.dumps([{c: _json_value(r.get(c)) for c in columns} for r in rows], indent=2, ensure_ascii=False, default=display_text)
    if kind == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(columns)
        writer.writerows([[";".join(map(display_text, r[c])) if isinstance(r.get(c), list) else display_text(r.get(c)) for c in columns] for r in rows])
        return out.getvalue().rstrip("\n")
    if kind == "table":
        return as_table(rows, columns, longest)
    raise ValueError(f"Unknown format '{kind}', expected one of {', '.join(FORMATS)}")

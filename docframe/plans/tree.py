"""Syntax tree of statements: plain immutable values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


class Node:
    """Base of all expression and condition nodes."""

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(value: object) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _nodes(v)


@dataclass(frozen=True)
class Literal(Node):
    #: str, int, float, bool or None
    value: object


@dataclass(frozen=True)
class Name(Node):
    text: str


@dataclass(frozen=True)
class Arithmetic(Node):
    sign: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negated(Node):
    value: Node


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None = None


@dataclass(frozen=True)
class Today(Node):
    pass


@dataclass(frozen=True)
class Now(Node):
    pass


@dataclass(frozen=True)
class DateDiff(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class DateShift(Node):
    """A date or time, moved by a number of days; forward is False for minus."""

    date: Node
    days: Node
    forward: bool = True


@dataclass(frozen=True)
class Aggregate(Node):
    #: COUNT, SUM, AVG, MIN or MAX
    function: str
    #: None for COUNT(*)
    argument: Node | None


class Condition(Node):
    """Base of the nodes that are true or false."""


@dataclass(frozen=True)
class Compare(Condition):
    sign: str
    left: Node
    right: Node


@dataclass(frozen=True)
class NullTest(Condition):
    value: Node
    negated: bool


@dataclass(frozen=True)
class OneOf(Condition):
    value: Node
    choices: tuple[object, ...]


@dataclass(frozen=True)
class Like(Condition):
    value: Node
    pattern: Node
    negated: bool


@dataclass(frozen=True)
class Both(Condition):
    left: Node
    right: Node


@dataclass(frozen=True)
class Either(Condition):
    left: Node
    right: Node


@dataclass(frozen=True)
class Item:
    """One output column; value is None for *."""

    value: Node | None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (label(self.value) if self.value is not None else "*")


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: Select
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    table: TableRef | Derived
    left: str
    right: str


@dataclass(frozen=True)
class SortKey:
    value: Node
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: TableRef | Derived
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[SortKey, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[object, ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, object], ...]
    where: Node | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Node | None = None


@dataclass(frozen=True)
class RenameField:
    table: str
    old: str
    new: str


@dataclass(frozen=True)
class DropField:
    table: str
    field: str


@dataclass(frozen=True)
class MergeFields:
    table: str
    fields: tuple[str, ...]
    into: str


@dataclass(frozen=True)
class CreateView:
    name: str
    query: Select
    text: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class DropView:
    name: str


Statement = Select | Insert | Update | Delete | RenameField | DropField | MergeFields | CreateView | DropView


def number_text(value: float) -> str:
    """A float as text without an exponent, whole numbers without a fraction."""
    if value != value or value in (float("inf"), float("-inf")):
        return {"nan": "NaN"}.get(str(value), str(value))
    if value == int(value):
        return str(int(value)) if value or str(value)[0] != "-" else "-0"
    text = repr(value)
    if "e" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text


def label(node: Node) -> str:
    """The column name of an expression without an alias; parentheses are not part of it."""
    match node:
        case Literal(None):
            return "NULL"
        case Literal(str(s)):
            return f"'{s}'"
        case Literal(float(x)):
            return number_text(x)
        case Literal(value):
            return str(value)
        case Name(text):
            return text
        case Arithmetic(sign, left, right):
            return f"{label(left)} {sign} {label(right)}"
        case Negated(value):
            return f"-{label(value)}"
        case Case():
            return "CASE"
        case Today():
            return "CURRENT_DATE"
        case Now():
            return "CURRENT_TIMESTAMP"
        case DateDiff(left, right):
            return f"DATEDIFF({label(left)}, {label(right)})"
        case DateShift(date, days, forward):
            return f"DATE_ADD({label(date)}, {label(days) if forward else '-' + label(days)})"
        case Aggregate(function, argument):
            return f"{function}({'*' if argument is None else label(argument)})"
    return type(node).__name__.upper()


def has_aggregate(node: Node | None) -> bool:
    return node is not None and any(isinstance(n, Aggregate) for n in node.walk())

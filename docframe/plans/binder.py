"""From syntax trees to lazy DataFrames.

Tables are renamed to positional column names while a statement is bound, so that names with dots, spaces
or different case never meet Spark's own resolution, and get their names at the end. What to do is left
to Catalyst: filters, pruning, join strategy and top-k come from the DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import QueryExecutionError
from docframe.functions import values as v
from docframe.functions.values import Typed
from docframe.plans import tree as t


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Table:
    """A table of the catalog: a DataFrame with optional row order and undeclared columns.

    key: column that gives the rows' order (ties in sorts, first row of a group). open_maps: hidden map
    columns in which names that are no column are looked up. hidden: columns that * leaves out.
    """

    df: DataFrame
    key: str | None = None
    open_maps: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    #: Columns of * in place of the DataFrame's own, those in open_maps among them.
    star: Callable[[], list[str]] | None = None


@dataclass(frozen=True)
class Field:
    name: str
    internal: str
    data_type: T.DataType
    qualifier: str | None = None
    hidden: bool = False
    #: A shorter name that counts where it is the only one.
    short: str | None = None

    def typed(self) -> Typed:
        return v.from_column(F.col(self.internal), self.data_type)


@dataclass
class Scope:
    """What names mean: fields of the input, aliases of the output, and values that are already computed."""

    fields: list[Field]
    strict: bool = False
    joined: bool = False
    key: str | None = None
    open_maps: list[str] = field(default_factory=list)
    aliases: dict[str, t.Node] = field(default_factory=dict)
    ready: dict[t.Node, Typed] = field(default_factory=dict)
    star: Callable[[], list[str]] | None = None

    def row_order(self) -> Column:
        """What gives the order of rows: the table's key, or else, and where rows of a join share it, all columns."""
        if self.key and not self.joined:
            return F.col(self.key)
        columns = [F.col(f.internal) if _orderable(f.data_type) else F.to_json(F.col(f.internal)) for f in self.fields]
        return F.struct(*([F.col(self.key)] if self.key else []), *columns)

    def find(self, name: str) -> Field | None:
        """The field that a name stands for, or None."""
        qualified = [f for f in self.fields if f.qualifier and f"{f.qualifier}.{f.name}" == name]
        for found in ([f for f in self.fields if f.name == name], qualified, [f for f in self.fields if f.short == name]):
            if len(found) == 1:
                return found[0]
            if found:
                raise QueryExecutionError(f"Column '{name}' is ambiguous")
        return None

    def lookup(self, name: str) -> Typed | None:
        """A column, a part of a dict column, or an undeclared column."""
        if found := self.find(name):
            return found.typed()
        for m in re.finditer(r"\.", name):
            head, path = name[: m.start()], name[m.end() :]
            base = self.find(head)
            if base and v.kind_of(base.data_type) == v.DICT:
                return _part(base, path)
        if self.open_maps and not self.joined:
            return Typed(F.coalesce(*[F.col(m)[name] for m in self.open_maps]), v.STRING)
        return None


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    return not isinstance(data_type, T.MapType | T.VariantType)


def _part(base: Field, path: str) -> Typed | None:
    column, data_type = F.col(base.internal), base.data_type
    if isinstance(data_type, T.MapType):
        return v.from_column(column[path], data_type.valueType)
    for f in data_type.fields:
        if f.name == path:
            return v.from_column(column.getField(f.name), f.dataType)
    return v.null()


class Binder:
    """Binds statements against named tables. strict: unknown columns are errors, not NULL."""

    def __init__(self, resolve: Callable[[str], Table], strict: bool = False) -> None:
        self.resolve = resolve
        self.strict = strict
        self._tables = 0

    # relations

    def _table(self, table: Table, qualifier: str | None) -> tuple[DataFrame, list[Field], Table]:
        """The table under positional names that no other table of the statement has."""
        k = self._tables
        self._tables += 1
        fields = [
            Field(f.name, f"t{k}_c{i}", f.dataType, qualifier, f.name in table.hidden, f.name.split(".", 1)[1] if "." in f.name else None)
            for i, f in enumerate(table.df.schema.fields)
        ]
        return table.df.toDF(*[f.internal for f in fields]), fields, table

    def _source(self, ref: t.TableRef | t.Derived) -> tuple[DataFrame, list[Field], Table]:
        if isinstance(ref, t.Derived):
            return self._table(Table(self.select(ref.query)), ref.alias)
        table = self.resolve(ref.name)
        return self._table(table, ref.alias or ref.name)

    def _relation(self, query: t.Select) -> tuple[DataFrame, Scope]:
        joined = bool(query.joins)
        df, fields, table = self._source(query.source)
        scope = Scope(fields, self.strict, joined)
        by_name = {f.name: f.internal for f in fields}
        scope.key = by_name.get(table.key) if table.key else None
        if not joined:
            scope.open_maps = [by_name[m] for m in table.open_maps]
            scope.star = table.star
        for join in query.joins:
            right, more, _ = self._source(join.table)
            left_value, right_value = self._sides(join, scope, Scope(more, True, joined))
            a, b = v.comparable(left_value, right_value)
            df = df.join(right, a == b, "inner")
            scope.fields = scope.fields + more
        return df, scope

    def _sides(self, join: t.Join, left: Scope, right: Scope) -> tuple[Typed, Typed]:
        """The two columns of ON; the one of the table that joins may stand on either side."""
        for mine, theirs in ((join.left, join.right), (join.right, join.left)):
            if right.find(theirs) and left.find(mine):
                return left.find(mine).typed(), right.find(theirs).typed()
        raise QueryExecutionError(f"Cannot resolve ON {join.left} = {join.right}")

    # statements

    def select(self, query: t.Select) -> DataFrame:
        df, scope = self._relation(query)
        if query.where is not None:
            df = df.where(self.condition(query.where, scope))
        items = list(query.items)
        star = items[0].value is None
        scope.aliases = {i.alias: i.value for i in items if i.alias}
        grouped = bool(query.group) or any(t.has_aggregate(n) for n in [*(i.value for i in items), query.having, *(k.value for k in query.order)])
        if grouped:
            if star:
                raise QueryExecutionError("SELECT * with GROUP BY is not supported")
            df, scope = self._aggregate(df, scope, query)
        if query.having is not None:
            df = df.where(self.condition(query.having, scope, aliased=True))
        if query.order:
            df = df.orderBy(*[self._sort_column(k, scope) for k in query.order], *([F.col(scope.key).asc()] if scope.key and not grouped else []))
        if query.limit is not None:
            df = df.limit(query.limit)
        out = self._star(scope) if star else [(self.value(i.value, scope), i.name) for i in items]
        return df.select(*[(x.column.cast("string") if x.kind == v.NULL else x.column).alias(name) for x, name in out])

    def _star(self, scope: Scope) -> list[tuple[Typed, str]]:
        shown = [f for f in scope.fields if not f.hidden]
        if scope.joined:
            return [(Typed(F.col(f.internal), v.kind_of(f.data_type)), f"{f.qualifier}.{f.name}" if f.qualifier else f.name) for f in shown]
        out = [(Typed(F.col(f.internal), v.kind_of(f.data_type)), f.name) for f in shown]
        for name in scope.star() if scope.star else []:
            out.append((scope.lookup(name), name))
        return out

    def _sort_column(self, key: t.SortKey, scope: Scope) -> Column:
        value = self.value(key.value, scope, aliased=True)
        column = v.display(value) if value.kind in (v.LIST, v.DICT) else value.column
        return column.desc_nulls_first() if key.descending else column.asc_nulls_last()

    def _aggregate(self, df: DataFrame, scope: Scope, query: t.Select) -> tuple[DataFrame, Scope]:
        """Grouped rows, and a scope in which keys, aggregates and first-row values are computed columns."""
        keys: dict[t.Node, Typed] = {}
        for node in query.group:
            target = node
            if isinstance(node, t.Name) and scope.lookup(node.text) is None and node.text in scope.aliases:
                target = scope.aliases[node.text]
            if t.has_aggregate(target):
                raise QueryExecutionError("GROUP BY cannot contain an aggregate")
            keys[node] = self.value(target, scope)
            keys.setdefault(target, keys[node])
        roots = [*(i.value for i in query.items), *([query.having] if query.having is not None else []), *(k.value for k in query.order)]
        wanted: dict[t.Node, Typed] = {}
        for root in roots:
            self._collect(root, keys, scope, wanted)
        ready: dict[t.Node, Typed] = {}
        columns, names = [], {}
        for node, value in keys.items():
            same = names.setdefault(id(value), f"k{len(names)}")
            if same not in [n for n, _ in columns]:
                columns.append((same, value.column))
            ready[node] = replace(value, column=F.col(same), literal=...)
        measures = []
        for i, (node, value) in enumerate(wanted.items()):
            measures.append(value.column.alias(f"a{i}"))
            ready[node] = replace(value, column=F.col(f"a{i}"), literal=...)
        measures = measures or [F.count(F.lit(1)).alias("a0")]
        grouped = df.groupBy(*[c.alias(n) for n, c in columns]).agg(*measures) if columns else df.agg(*measures)
        return grouped, Scope([], scope.strict, aliases=scope.aliases, ready=ready)

    def _collect(self, node: t.Node, keys: dict[t.Node, Typed], scope: Scope, wanted: dict[t.Node, Typed]) -> None:
        """Adds the aggregates of an expression, and the names outside of them as first-row values."""
        if node in keys or node in wanted:
            return
        if isinstance(node, t.Aggregate):
            wanted[node] = self._measure(node, scope)
        elif isinstance(node, t.Name):
            if node.text in scope.aliases and scope.lookup(node.text) is None:
                return
            found = self.value(node, scope)
            if found.kind == v.NULL:
                return
            wanted[node] = replace(found, column=F.min_by(found.column, scope.row_order()))
        else:
            for child in node.children():
                self._collect(child, keys, scope, wanted)

    def _measure(self, node: t.Aggregate, scope: Scope) -> Typed:
        if node.argument is None:
            return Typed(F.count(F.lit(1)), v.INT)
        if t.has_aggregate(node.argument):
            raise QueryExecutionError("Aggregates cannot be nested")
        value = self.value(node.argument, scope)
        match node.function:
            case "COUNT":
                return Typed(F.count(value.column), v.INT)
            case "SUM":
                return Typed(F.sum(v.as_double(value)), v.FLOAT)
            case "AVG":
                return Typed(F.avg(v.as_double(value)), v.FLOAT)
        text = value.kind in (v.LIST, v.DICT)
        column = v.display(value) if text else value.column
        return Typed(F.min(column) if node.function == "MIN" else F.max(column), v.STRING if text else value.kind)

    # expressions

    def condition(self, node: t.Node, scope: Scope, aliased: bool = False) -> Column:
        match node:
            case t.Both(left, right):
                return self.condition(left, scope, aliased) & self.condition(right, scope, aliased)
            case t.Either(left, right):
                return self.condition(left, scope, aliased) | self.condition(right, scope, aliased)
            case t.Compare(sign, left, right):
                return v.compare(sign, self.value(left, scope, aliased), self.value(right, scope, aliased))
            case t.NullTest(value, negated):
                column = self.value(value, scope, aliased).column
                return column.isNotNull() if negated else column.isNull()
            case t.OneOf(value, choices):
                return v.one_of(self.value(value, scope, aliased), choices)
            case t.Like(value, pattern, negated):
                if not isinstance(pattern, t.Literal):
                    raise QueryExecutionError("LIKE needs a literal pattern")
                return v.like(self.value(value, scope, aliased), pattern.value, negated)
        raise QueryExecutionError(f"Not a condition: {t.label(node)}")

    def value(self, node: t.Node, scope: Scope, aliased: bool = False) -> Typed:
        """aliased: names of output columns count too, where no input column has the name."""
        if node in scope.ready:
            return scope.ready[node]
        match node:
            case t.Literal(value):
                return v.from_literal(value)
            case t.Name(name):
                return self._name(name, scope, aliased)
            case t.Arithmetic(sign, left, right):
                return v.arithmetic(sign, self.value(left, scope, aliased), self.value(right, scope, aliased))
            case t.Negated(inner):
                return v.negate(self.value(inner, scope, aliased))
            case t.Case(branches, otherwise):
                whens = [self.condition(w, scope, aliased) for w, _ in branches]
                results = [self.value(r, scope, aliased) for _, r in branches]
                results.append(self.value(otherwise, scope, aliased) if otherwise is not None else v.null())
                columns, kind = v.unified(results)
                out = F.when(whens[0], columns[0])
                for when, column in zip(whens[1:], columns[1:-1], strict=True):
                    out = out.when(when, column)
                types = [r.data_type for r in results if r.data_type is not None]
                return Typed(out.otherwise(columns[-1]), kind, data_type=types[0] if types and kind in (v.LIST, v.DICT) else None)
            case t.Today():
                return Typed(F.current_date(), v.DATE)
            case t.Now():
                return Typed(F.localtimestamp(), v.DATETIME)
            case t.DateDiff(left, right):
                return v.day_difference(self.value(left, scope, aliased), self.value(right, scope, aliased))
            case t.DateShift(date, days, forward):
                return v.shift_days(self.value(date, scope, aliased), self.value(days, scope, aliased), forward)
            case t.Aggregate():
                raise QueryExecutionError(f"{t.label(node)} is not allowed here")
        raise QueryExecutionError(f"Not a value: {t.label(node)}")

    def _name(self, name: str, scope: Scope, aliased: bool) -> Typed:
        # a sort or HAVING may name a computed output column; an input column of the name comes first
        if aliased and name in scope.aliases and (scope.ready or scope.find(name) is None):
            target = scope.aliases[name]
            if target != t.Name(name):
                return self.value(target, scope)
        if (found := scope.lookup(name)) is not None:
            return found
        # names may hold - and /, so that a-b is one name unless only its parts are columns
        parts = re.split(r"([-/])", name)
        if len(parts) > 1 and all(p.isdigit() or scope.lookup(p) is not None for p in parts[::2]) and not all(p.isdigit() for p in parts[::2]):
            node: t.Node = _leaf(parts[0])
            for sign, part in zip(parts[1::2], parts[2::2], strict=True):
                if sign == "/" and isinstance(node, t.Arithmetic) and node.sign == "-":
                    node = replace(node, right=t.Arithmetic("/", node.right, _leaf(part)))
                else:
                    node = t.Arithmetic(sign, node, _leaf(part))
            return self.value(node, scope, aliased)
        if self.strict or scope.joined and "." not in name and scope.strict:
            raise QueryExecutionError(f"Unknown column '{name}'")
        return v.null()


def _leaf(part: str) -> t.Node:
    return t.Literal(int(part)) if part.isdigit() else t.Name(part)

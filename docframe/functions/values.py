"""Kinds of values, their text form, comparison and arithmetic, as Spark columns.

A Typed value pairs a column with its kind, so that the rules that depend on types are decided when a
statement is bound and Catalyst sees ordinary expressions. Nothing here depends on whether the session
is in ANSI mode: overflow and division by zero give NULL.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.plans.tree import number_text

INT, FLOAT, BOOL, STRING, DATE, DATETIME, LIST, DICT, NULL = "int", "float", "bool", "string", "date", "datetime", "list", "dict", "null"
NUMBERS = (INT, FLOAT)
TIMES = (DATE, DATETIME)

#: Declared field types and their Spark types.
DECLARED: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "string[]": T.ArrayType(T.StringType()),
    "dict": T.MapType(T.StringType(), T.StringType()),
}

_ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_ISO_TIME = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?")


def kind_of(data_type: T.DataType) -> str:
    """The kind that a Spark type has in the dialect."""
    match data_type:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return INT
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return FLOAT
        case T.BooleanType():
            return BOOL
        case T.DateType():
            return DATE
        case T.TimestampNTZType() | T.TimestampType():
            return DATETIME
        case T.ArrayType():
            return LIST
        case T.StructType() | T.MapType():
            return DICT
        case T.NullType():
            return NULL
    return STRING


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    #: For literals, the value; a column has the marker NO_LITERAL.
    literal: object = ...
    data_type: T.DataType | None = None

    @property
    def is_literal(self) -> bool:
        return self.literal is not ...


def null() -> Typed:
    return Typed(F.lit(None), NULL, None)


def from_column(column: Column, data_type: T.DataType) -> Typed:
    """A column of a table, widened to the dialect's one integer, float and time type."""
    kind = kind_of(data_type)
    if kind == INT and not isinstance(data_type, T.LongType):
        column = column.cast("bigint")
    elif kind == FLOAT and not isinstance(data_type, T.DoubleType):
        column = column.cast("double")
    elif isinstance(data_type, T.TimestampType):
        column = column.cast("timestamp_ntz")
    return Typed(column, kind, data_type=data_type)


def from_literal(value: object) -> Typed:
    match value:
        case None:
            return null()
        case bool():
            return Typed(F.lit(value), BOOL, value)
        case int():
            return Typed(F.lit(value).cast("bigint"), INT, value) if abs(value) < 1 << 63 else Typed(F.lit(float(value)), FLOAT, float(value))
        case float():
            return Typed(F.lit(value), FLOAT, value)
    return Typed(F.lit(str(value)), STRING, str(value))


def _float_text(x: Column) -> Column:
    whole = F.when((x == 0) & (F.lit(1.0) / F.when(x != 0, x).otherwise(F.lit(1.0)) > 0), F.lit("0")).otherwise(x.cast("bigint").cast("string"))
    plain = x.cast("string")
    long_form = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(x) | (F.abs(x) == float("inf")), plain)
        .when((x == F.floor(x)) & (F.abs(x) < 9e18), whole)
        .when(plain.contains("E") & (F.abs(x) < 1e19), long_form)
        .otherwise(plain)
    )


def display(v: Typed) -> Column:
    """The text form of a value; NULL stays NULL."""
    if v.is_literal and v.literal is not None:
        return F.lit(display_text(v.literal))
    c = v.column
    match v.kind:
        case "float":
            return _float_text(c)
        case "datetime":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        case "list":
            return F.array_join(c.cast("array<string>"), ", ")
        case "dict":
            if isinstance(v.data_type, T.StructType):
                parts = [
                    F.concat(F.lit(f"{f.name}: "), F.coalesce(display(from_column(c.getField(f.name), f.dataType)), F.lit("")))
                    for f in v.data_type.fields
                ]
                body = F.array_join(F.array(*parts), ", ")
            else:
                pairs = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit(""))))
                body = F.array_join(pairs, ", ")
            return F.when(c.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))
    return c.cast("string")


def display_text(value: object) -> str:
    """The text form of a Python value."""
    match value:
        case None:
            return ""
        case bool():
            return "true" if value else "false"
        case float():
            return number_text(value)
        case dt.datetime():
            return value.isoformat(timespec="seconds")
        case dt.date():
            return value.isoformat()
        case list() | tuple():
            return ", ".join(map(display_text, value))
        case dict():
            return "{" + ", ".join(f"{k}: {display_text(v)}" for k, v in value.items()) + "}"
    return str(value)


def as_double(v: Typed) -> Column:
    return v.column.cast("double") if v.kind in NUMBERS else F.lit(None).cast("double")


def comparable(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Both sides in a type in which Spark's ordering is the dialect's."""
    if a.kind == b.kind and a.kind not in (LIST, DICT):
        return a.column, b.column
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return as_double(a), as_double(b)
    if a.kind in TIMES and b.kind in TIMES:
        return a.column.cast("timestamp_ntz"), b.column.cast("timestamp_ntz")
    return display(a), display(b)


def _signed(sign: str, a: Column, b: Column) -> Column:
    match sign:
        case "=":
            return a == b
        case "!=":
            return a != b
        case "<":
            return a < b
        case "<=":
            return a <= b
        case ">":
            return a > b
    return a >= b


_FLIPPED = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _with_time_text(sign: str, time: Typed, text: str) -> Column | None:
    """A date or time against an ISO literal as a comparison that reaches the scan.

    The rule is a comparison of texts, in which a time has whole seconds, and midnight sorts after a date
    without a time.
    """
    c = time.column
    if time.kind == DATE:
        if not _ISO_DATE.fullmatch(text) or not _valid(text):
            return None
        return _signed(sign, c, F.lit(dt.date.fromisoformat(text)))
    if _ISO_DATE.fullmatch(text) and _valid(text):
        day = F.lit(text).cast("timestamp_ntz")
        match sign:
            case "=":
                return F.when(c.isNotNull(), F.lit(False))
            case "!=":
                return c.isNotNull()
        return c >= day if sign in (">", ">=") else c < day
    if _ISO_TIME.fullmatch(text) and "." not in text and _valid(text):
        at = dt.datetime.fromisoformat(text)
        here, after = (F.lit(x.isoformat()).cast("timestamp_ntz") for x in (at, at + dt.timedelta(seconds=1)))
        match sign:
            case "=":
                return (c >= here) & (c < after)
            case "!=":
                return (c < here) | (c >= after)
            case "<":
                return c < here
            case ">=":
                return c >= here
            case "<=":
                return c < after
        return c >= after
    return None


def _valid(text: str) -> bool:
    try:
        dt.datetime.fromisoformat(text)
    except ValueError:
        return False
    return True


def compare(sign: str, a: Typed, b: Typed) -> Column:
    """A comparison; NULL on either side gives NULL, which filters like false."""
    if a.kind == NULL or b.kind == NULL:
        return F.lit(None).cast("boolean")
    for time, other, s in ((a, b, sign), (b, a, _FLIPPED[sign])):
        if time.kind in TIMES and isinstance(other.literal, str):
            if (found := _with_time_text(s, time, other.literal)) is not None:
                return found
            return _signed(s, display(time), F.lit(other.literal))
    return _signed(sign, *comparable(a, b))


def one_of(v: Typed, choices: tuple[object, ...]) -> Column:
    """IN: literals take the value's type; of a list, any element may match."""
    if v.kind == LIST:
        texts = [c for c in choices if isinstance(c, str)]
        if not texts:
            return F.when(v.column.isNotNull(), F.lit(False))
        return F.coalesce(F.arrays_overlap(v.column.cast("array<string>"), F.array(*map(F.lit, texts))), F.lit(False))
    wanted = [c for c in (_coerced(v.kind, c) for c in choices) if c is not None]
    if not wanted:
        return F.when(v.column.isNotNull(), F.lit(False)) if v.kind != NULL else F.lit(None).cast("boolean")
    return v.column.isin(*wanted)


def _coerced(kind: str, choice: object) -> object:
    """choice as a literal of kind, or None if it never equals such a value."""
    is_number = isinstance(choice, int | float) and not isinstance(choice, bool)
    try:
        match kind:
            case "int":
                return int(choice) if isinstance(choice, int) and is_number or isinstance(choice, str) and re.fullmatch(r"[+-]?\d+", choice) else None
            case "float":
                return float(choice) if is_number or isinstance(choice, str) else None
            case "bool":
                return choice if isinstance(choice, bool) else None
            case "date":
                return dt.date.fromisoformat(choice) if isinstance(choice, str) and _ISO_DATE.fullmatch(choice) else None
            case "datetime":
                if isinstance(choice, str) and _ISO_TIME.fullmatch(choice) and _valid(choice):
                    return F.lit(choice).cast("timestamp_ntz")
                return None
            case "string":
                return choice if isinstance(choice, str) else None
    except ValueError:
        pass
    return None


def like(v: Typed, pattern: object, negated: bool) -> Column:
    """LIKE: regardless of case, without an escape sign, over any value's text; of a list, any element."""
    if not isinstance(pattern, str):
        return F.lit(False)
    if v.kind == NULL:
        return F.lit(None).cast("boolean")
    own = pattern.replace("\\", "\\\\")
    if v.kind == LIST:
        found = F.coalesce(F.exists(v.column.cast("array<string>"), lambda e: e.ilike(own)), F.lit(False))
        found = F.when(v.column.isNotNull(), found)
    else:
        found = display(v).ilike(own)
    return ~found if negated else found


def arithmetic(sign: str, a: Typed, b: Typed) -> Typed:
    """+ - * / %: integers stay integers (division truncates, overflow is NULL), other numbers are floats."""
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return null()
    if a.kind == b.kind == INT:
        x, y = a.column, b.column
        match sign:
            case "+":
                out = F.try_add(x, y)
            case "-":
                out = F.try_subtract(x, y)
            case "*":
                out = F.try_multiply(x, y)
            case "/":
                # the one quotient that overflows
                fits = (y != 0) & ~((y == -1) & (x == -(1 << 63)))
                out = F.when(fits, F.call_function("div", x, y))
            case _:
                out = F.try_mod(x, y)
        return Typed(out, INT)
    x, y = as_double(a), as_double(b)
    match sign:
        case "+":
            return Typed(x + y, FLOAT)
        case "-":
            return Typed(x - y, FLOAT)
        case "*":
            return Typed(x * y, FLOAT)
        case "/":
            return Typed(F.when(y != 0, F.try_divide(x, y)), FLOAT)
    return Typed(F.when(y != 0, F.try_mod(x, y)), FLOAT)


def negate(v: Typed) -> Typed:
    if v.kind == INT:
        return Typed(F.try_subtract(F.lit(0).cast("bigint"), v.column), INT)
    return Typed(-v.column, FLOAT) if v.kind == FLOAT else null()


def shift_days(date: Typed, days: Typed, forward: bool) -> Typed:
    if date.kind not in TIMES or days.kind not in NUMBERS:
        return null()
    n = days.column.cast("double")
    n = F.when(F.abs(n) < 3_000_000, n.cast("int"))
    n = n if forward else -n
    if date.kind == DATE:
        return Typed(F.date_add(date.column, n), DATE)
    return Typed(date.column + F.make_dt_interval(days=n), DATETIME)


def day_difference(a: Typed, b: Typed) -> Typed:
    """Whole days of a - b, cut toward zero."""
    if a.kind not in TIMES or b.kind not in TIMES:
        return null()
    if a.kind == b.kind == DATE:
        return Typed(F.datediff(a.column, b.column).cast("bigint"), INT)
    return Typed(F.timestamp_diff("DAY", b.column.cast("timestamp_ntz"), a.column.cast("timestamp_ntz")).cast("bigint"), INT)


def unified(values: list[Typed]) -> tuple[list[Column], str]:
    """Columns of one type for the branches of a CASE: numbers widen, other mixtures become text."""
    kinds = {v.kind for v in values} - {NULL}
    if not kinds:
        return [v.column for v in values], NULL
    if len(kinds) == 1:
        kind = kinds.pop()
        types = {str(v.data_type) for v in values if v.kind == kind and v.data_type is not None}
        if kind not in (LIST, DICT) or len(types) <= 1:
            return [v.column for v in values], kind
        return [display(v) if v.kind != NULL else v.column.cast("string") for v in values], STRING
    if kinds <= set(NUMBERS):
        return [as_double(v) for v in values], FLOAT
    if kinds <= set(TIMES):
        return [v.column.cast("timestamp_ntz") for v in values], DATETIME
    return [display(v) if v.kind != NULL else v.column.cast("string") for v in values], STRING

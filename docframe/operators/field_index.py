"""An index of scalar columns: which rows have which values, as a table on disk.

Queries do not use it, as Parquet statistics and pushed filters serve them; it is for look-ups by value and
for keeping such look-ups current row by row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.values import DICT, LIST, NUMBERS, display, from_column
from docframe.plans.binder import quoted
from docframe.sources.snapshot import Versions

SIGNS = ("=", "<", "<=", ">", ">=")


def field_values(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows (field, text, number, key) of all non-null scalar values; lists and dicts are not indexed."""
    parts = []
    for c in columns:
        value = from_column(F.col(quoted(c)), df.schema[c].dataType)
        if value.kind in (LIST, DICT):
            continue
        number = value.column.cast("double") if value.kind in NUMBERS else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(c).alias("field"), display(value).alias("text"), number.alias("number")))
    if not parts:
        return df.select(F.lit("").alias("field"), F.lit("").alias("text"), F.lit(0.0).alias("number"), F.col(quoted(key)).alias("key")).limit(0)
    rows = df.select(F.col(quoted(key)).alias("key"), F.explode(F.array(*parts)).alias("v"))
    return rows.where("v.text is not null").select("v.field", "v.text", "v.number", "key")


class FieldIndex:
    """Look-ups give tables of keys, which combine like sets.

    The values are written below `place` (a temporary folder, if none is given), sorted by field and value, so that a
    look-up reads the parts that may hold its value. Each update writes a new version and renames the manifest, so that
    neither plans nor look-ups grow with the number of updates. place: a folder; an index found there is taken as it is.
    """

    def __init__(self, df: DataFrame, key: str, columns: Sequence[str], place: str | Path | None = None) -> None:
        self.key, self.columns = key, list(columns)
        self._own = None if place else tempfile.TemporaryDirectory(prefix="docframe-")
        self.versions = Versions(df.sparkSession, place or self._own.name)
        if not self.versions.manifest():
            self._write(field_values(df, key, columns))

    def _write(self, values: DataFrame) -> None:
        ordered = values.repartitionByRange("field", "text").sortWithinPartitions("field", "text")
        self.versions.replace(lambda target: ordered.write.parquet(target))

    @property
    def values(self) -> DataFrame:
        return self.versions.read()

    def compare(self, field: str, sign: str, value: object) -> DataFrame:
        """Keys of rows whose value stands so to the given one: numbers as numbers, others as texts."""
        if sign not in SIGNS:
            raise ValueError(f"sign must be one of {', '.join(SIGNS)}")
        is_number = isinstance(value, int | float) and not isinstance(value, bool)
        column = "number" if is_number else "text"
        wanted = F.lit(float(value)) if is_number else F.lit(str(value))
        own = F.col(column)
        test = {"=": own == wanted, "<": own < wanted, "<=": own <= wanted, ">": own > wanted, ">=": own >= wanted}[sign]
        return self.values.where((F.col("field") == field) & test).select("key")

    def between(self, field: str, low: object, high: object) -> DataFrame:
        return self.both(self.compare(field, ">=", low), self.compare(field, "<=", high))

    def one_of(self, field: str, values: Iterable[object]) -> DataFrame:
        found = [self.compare(field, "=", v) for v in values]
        out = found[0] if found else self.values.select("key").limit(0)
        for f in found[1:]:
            out = out.union(f)
        return out.distinct()

    @staticmethod
    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, "key", "left_semi")

    @staticmethod
    def either(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.union(right).distinct()

    def _without(self, keys: DataFrame) -> DataFrame:
        return self.values.join(keys.select("key").distinct(), "key", "left_anti").select("field", "text", "number", "key")

    def invalidate(self, keys: DataFrame) -> None:
        """Removes rows; keys: a table with the column key."""
        self._write(self._without(keys))

    def update(self, df: DataFrame) -> None:
        """Takes new or changed rows in."""
        kept = self._without(df.select(F.col(quoted(self.key)).alias("key")))
        self._write(kept.union(field_values(df, self.key, self.columns)))

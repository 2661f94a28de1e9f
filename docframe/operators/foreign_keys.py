"""Foreign-key checks as anti-joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.values import LIST, Typed, display, from_column
from docframe.plans.binder import Table, quoted
from docframe.sources.folder import PROBLEM
from docframe.sources.schema import ForeignKey


def _texts(df: DataFrame, column: str, also: list[str]) -> DataFrame:
    """The non-null values of a column as text (of a list, its elements), with other columns."""
    value = from_column(F.col(quoted(column)), df.schema[column].dataType)
    if value.kind == LIST:
        return df.select(*also, F.explode(value.column.cast("array<string>")).alias("__value")).where("__value is not null")
    return df.select(*also, display(Typed(value.column, value.kind, data_type=value.data_type)).alias("__value")).where("__value is not null")


def key_violations(child: DataFrame, parent: DataFrame, key: ForeignKey, path_column: str = "path") -> DataFrame:
    """Rows of child whose non-null reference is no value of the parent's column.

    One anti-join on text values: the parent's distinct values are not collected, and a hot value of the
    child's is a large key, which adaptive execution splits.
    """
    here = F.col(quoted(path_column)).cast("string").alias("__path") if path_column in child.columns else F.lit(None).cast("string").alias("__path")
    refs = _texts(child, key.from_column, [here])
    known = _texts(parent, key.to_column, []).distinct()
    missing = refs.join(known, "__value", "left_anti")
    return missing.select(
        F.concat_ws("/", F.lit(key.from_table), "__path").alias("file_path"),
        F.lit("fk_violation").alias("error_type"),
        F.lit(key.from_column).alias("field"),
        F.concat(F.lit(f"{key.from_column} = '"), "__value", F.lit(f"' not found in {key.to_table}.{key.to_column}")).alias("message"),
        F.lit(None).cast("bigint").alias("line_number"),
    )


def check_foreign_keys(
    spark: SparkSession, keys: Iterable[ForeignKey], tables: Callable[[str], Table | None], path_column: str = "path"
) -> DataFrame:
    """All violations of all keys; a table that is not there is one row."""
    out = spark.createDataFrame([], PROBLEM)
    for key in keys:
        child, parent = tables(key.from_table), tables(key.to_table)
        missing = [n for n, t in ((key.from_table, child), (key.to_table, parent)) if t is None]
        for name in missing:
            text = f"Foreign key {key.from_table}.{key.from_column} -> {key.to_table}.{key.to_column}: no table '{name}'"
            out = out.union(spark.createDataFrame([(name, "fk_missing_table", key.from_column, text, None)], PROBLEM))
        if missing:
            continue
        if key.from_column not in child.df.columns:
            continue
        if key.to_column not in parent.df.columns:
            known = parent.df.select(F.lit(None).cast("string").alias(key.to_column)).limit(0)
            out = out.union(key_violations(child.df, known, key, path_column))
            continue
        out = out.union(key_violations(child.df, parent.df, key, path_column))
    return out

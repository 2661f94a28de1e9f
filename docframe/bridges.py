"""Tables as pandas and polars data frames."""

from __future__ import annotations

import warnings
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docframe.errors import DocframeError
from docframe.operators.catalog import Table


def to_pandas(df: DataFrame) -> Any:
    """A result as a pandas data frame, through Arrow."""
    return df.toPandas()


def to_polars(df: DataFrame) -> Any:
    """A result as a polars data frame, where polars is installed."""
    try:
        import polars
    except ImportError:
        raise DocframeError("polars is not installed") from None
    return polars.from_arrow(df.toArrow())


def _loaded(path: str | Path, spark: SparkSession | None, errors: str) -> DataFrame:
    if errors not in ("warn", "raise", "ignore"):
        raise ValueError("errors must be warn, raise or ignore")
    table = Table(path, spark)
    if errors != "ignore" and (found := table.validate()):
        text = "; ".join(f"{p.file_path}: {p.message}" for p in found)
        if errors == "raise":
            raise DocframeError(text)
        warnings.warn(text, stacklevel=3)
    return table.df.orderBy("path")


def load_pandas(path: str | Path, spark: SparkSession | None = None, errors: str = "warn") -> Any:
    """The valid rows of a folder; errors: what to do about the others."""
    return to_pandas(_loaded(path, spark, errors))


def load_polars(path: str | Path, spark: SparkSession | None = None, errors: str = "warn") -> Any:
    return to_polars(_loaded(path, spark, errors))

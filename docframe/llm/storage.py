"""Intermediate tables in the folder that the driver and all executors share.

Every intermediate is a folder below `<shared>/docframe/`. Inside `scratch` those made in the block are removed
at its end; what remains (results of queries, and intermediates that a lazy result still reads) is removed when
the application's JVM ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_open = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or else the context's own checkpoint folder.

    Where neither is set, a local session (as in tests) gets a new temporary folder; on a cluster this is an
    error, since executors would write to disks of their own.
    """
    named = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def new_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate, noted for removal with the innermost scratch block or with the application."""
    path = f"{shared_dir(spark)}/docframe/{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    files, target = _hadoop(spark, path)
    files.deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends at replicated files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _hadoop(spark, path)
    files.delete(target, True)
    files.cancelDeleteOnExit(target)


def move(spark: SparkSession, path: str, to: str) -> None:
    files, target = _hadoop(spark, path)
    if not files.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be moved to {to}")


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop(spark, path)
    return files.exists(target)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at the end of the block the intermediates that were made in it."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            remove(spark, path)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a table of their own; all that make stored on the way is removed."""
    path = new_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

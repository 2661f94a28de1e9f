"""Watching document folders: a stream of changed files, and checks that follow it."""

from __future__ import annotations

import json
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from docframe.errors import DocframeError
from docframe.operators.catalog import Database
from docframe.operators.foreign_keys import key_violations
from docframe.sources.markdown import Problem
from docframe.sources.schema import ForeignKey

#: How often a watched folder is looked at.
INTERVAL = "500 milliseconds"


def folder_listing(root: str) -> dict[str, str]:
    """Documents at or below root, with time of change and size."""
    out = {}
    for top, _, names in os.walk(root):
        for name in names:
            if name.endswith(".md"):
                path = os.path.join(top, name)
                try:
                    s = os.stat(path)
                except FileNotFoundError:
                    continue
                out[os.path.relpath(path, root)] = f"{s.st_mtime_ns}:{s.st_size}"
    return out


def _changes(before: dict[str, str], after: dict[str, str]) -> Iterator[tuple[str, str]]:
    for path in sorted({*before, *after}):
        if before.get(path) != after.get(path):
            yield path, "create" if path not in before else "remove" if path not in after else "modify"


class _Reader(SimpleDataSourceStreamReader):
    """An offset is the number of a set of changes, so that it is as small for a million files as for one.

    Next to the numbered sets, in the log's folder, is the listing that the last of them led to. A batch is read again
    from its sets; those of committed batches are removed.
    """

    def __init__(self, root: str, log: str) -> None:
        self.root, self.log = root, Path(log)

    def _write(self, name: str, value: object) -> None:
        fresh = self.log / f"{name}.new"
        fresh.write_text(json.dumps(value))
        os.replace(fresh, self.log / name)

    def initialOffset(self) -> dict:
        self.log.mkdir(parents=True, exist_ok=True)
        self._write("listing.json", folder_listing(self.root))
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = folder_listing(self.root)
        found = list(_changes(json.loads((self.log / "listing.json").read_text()), now))
        if not found:
            return iter(()), start
        self._write(f"{start['n'] + 1}.json", found)
        self._write("listing.json", now)
        return iter(found), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([tuple(c) for n in range(start["n"] + 1, end["n"] + 1) for c in json.loads((self.log / f"{n}.json").read_text())])

    def commit(self, end: dict) -> None:
        for path in self.log.glob("[0-9]*.json"):
            if int(path.stem) <= end["n"]:
                path.unlink(missing_ok=True)


class FolderChanges(DataSource):
    """spark.readStream.format("folder_changes").load(root): rows (path, change).

    Option log: a folder for what the stream must remember between batches; a restarted stream goes on from it.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, change string"

    def simpleStreamReader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"], self.options.get("log") or tempfile.mkdtemp(prefix="docframe-log-"))


class Watcher:
    """Re-checks a database whenever its files change, and holds the latest result.

    Micro-batches take all changes since the last one, so the last change is never lost.
    """

    def __init__(self, database: Database, interval: str = INTERVAL, on_result: Callable[[list[Problem]], None] | None = None) -> None:
        self.database, self.interval, self.on_result = database, interval, on_result
        self._lock = threading.Lock()
        self._latest: list[Problem] | None = None
        self._query = None

    def _check(self, batch: DataFrame, _: int) -> None:
        try:
            self.database.reload()
            found = [Problem(*r) for r in self.database.foreign_key_errors().collect()]
        except DocframeError as e:  # a half-edited schema must not end the stream
            found = [Problem(self.database.name, "reload_error", None, str(e))]
        with self._lock:
            self._latest = found
        if self.on_result:
            self.on_result(found)

    def start(self) -> Watcher:
        spark = self.database.spark
        spark.dataSource.register(FolderChanges)
        self._log = tempfile.TemporaryDirectory(prefix="docframe-log-")
        changes = spark.readStream.format("folder_changes").option("log", self._log.name).load(str(self.database.path.absolute()))
        place = f"{_scratch(spark)}/watch-{uuid.uuid4().hex}"
        self._query = changes.writeStream.trigger(processingTime=self.interval).option("checkpointLocation", place).foreachBatch(self._check).start()
        return self

    def poll(self) -> list[Problem] | None:
        """The newest result since the last call, or None."""
        with self._lock:
            found, self._latest = self._latest, None
        return found

    def stop(self) -> None:
        if self._query:
            self._query.stop()


def _scratch(spark: SparkSession) -> str:
    """The shared checkpoint folder; in a local session without one, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise DocframeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or Path(tempfile.mkdtemp(prefix="docframe-")).as_uri()).rstrip("/")


def stream_violations(stream: DataFrame, parent: DataFrame, key: ForeignKey, path_column: str) -> DataFrame:
    """Checks a bounded stream of child rows against a table: a stateless stream-static anti-join.

    Runs until all that is available has been read, and returns the violations, which it has written as
    Parquet to the shared folder; a restart would go on from the stream's checkpoint.
    """
    spark = stream.sparkSession
    place = f"{_scratch(spark)}/stream-{uuid.uuid4().hex}"
    found = key_violations(stream, parent, key, path_column)
    query = (
        found.writeStream.trigger(availableNow=True).outputMode("append").format("parquet")
        .option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").start()
    )
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{place}/out")

"""Snapshots: a parsed folder as Parquet, brought up to date by the files that changed."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.sources.folder import scan_folder
from docframe.sources.schema import SCHEMA_FILE, TableSchema


def listing(folder: str | Path) -> dict[str, list[int]]:
    """Name, time of change and size of each document."""
    with os.scandir(folder) as entries:
        return {
            e.name: [e.stat().st_mtime_ns, e.stat().st_size]
            for e in entries
            if e.name.endswith(".md") and not e.name.startswith(".") and e.name != SCHEMA_FILE and e.is_file()
        }


class Versions:
    """A folder with one current version of some tables, and a manifest that names it.

    A version becomes current by renaming the manifest; a broken one is never seen. What is at the place is
    disposable: it can be written again from its sources.
    """

    def __init__(self, spark: SparkSession, place: str | Path) -> None:
        self.spark, self.place = spark, Path(place)

    def manifest(self) -> dict | None:
        try:
            return json.loads((self.place / "manifest.json").read_text())
        except (OSError, ValueError):
            return None

    def read(self, table: str = "") -> DataFrame:
        return self.spark.read.parquet(str(self.place / self.manifest()["version"] / table))

    def replace(self, write: Callable[[str], None], note: dict | None = None) -> None:
        """write: writes the new version's tables below the path it is given. note: kept in the manifest."""
        old = self.manifest()
        version = f"v{(int(old['version'][1:]) if old else 0) + 1}"
        target = self.place / version
        shutil.rmtree(target, ignore_errors=True)
        self.place.mkdir(parents=True, exist_ok=True)
        write(str(target))
        fresh = self.place / "manifest.json.new"
        fresh.write_text(json.dumps((note or {}) | {"version": version}))
        os.replace(fresh, self.place / "manifest.json")
        if old:
            shutil.rmtree(self.place / old["version"], ignore_errors=True)


class Snapshot:
    """A disposable copy of parsed documents.

    A version holds all documents of the folder as it was listed, under one schema. If nothing changed
    it is read as it is; otherwise only new and changed files are parsed, and the rest is taken over.
    """

    def __init__(self, spark: SparkSession, place: str | Path) -> None:
        self.spark, self.versions = spark, Versions(spark, place)

    def parsed(self, folder: str | Path, schema: TableSchema) -> DataFrame:
        files, rule = listing(folder), hashlib.sha256(repr(schema).encode()).hexdigest()
        old = self.versions.manifest()
        if old and old["rule"] == rule and old["files"] == files:
            return self.versions.read()
        if old and old["rule"] == rule:
            changed = [n for n, s in files.items() if old["files"].get(n) != s]
            gone = [n for n, s in old["files"].items() if files.get(n) != s]
            kept = self.versions.read()
            if gone:
                names = self.spark.createDataFrame([(n,) for n in gone], "path string")
                kept = kept.join(F.broadcast(names) if len(gone) < 100_000 else names, "path", "left_anti")
            now = kept.unionByName(scan_folder(self.spark, folder, schema, changed)) if changed else kept
        else:
            now = scan_folder(self.spark, folder, schema)
        self.versions.replace(lambda target: now.write.parquet(target), {"rule": rule, "files": files})
        return self.versions.read()

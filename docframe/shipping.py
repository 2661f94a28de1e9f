"""Getting the package to the workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for an application.

    Nothing is sent where workers find it anyway: its folder is in PYTHONPATH, is the working folder, or
    the package was given with --py-files.
    """
    context = spark.sparkContext
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or any(Path(p).resolve() == ROOT for p in [*paths, os.getcwd()]) or ROOT.suffix == ".zip":
        return
    target = Path(tempfile.mkdtemp(prefix="docframe-")) / "docframe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted((ROOT / "docframe").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)

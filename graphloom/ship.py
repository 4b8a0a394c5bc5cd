"""Make this package importable by Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Add the package as a zip to the context, once, unless the workers' path already has its folder."""
    sc = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(_ROOT.parent) in paths or sc.applicationId in _shipped:
        return
    fd, name = tempfile.mkstemp(prefix="graphloom-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, Path(_ROOT.name) / p.relative_to(_ROOT))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)

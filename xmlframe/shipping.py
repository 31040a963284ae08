"""The package for executors that do not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless PYTHONPATH already has it."""
    top = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(top) in os.environ.get("PYTHONPATH", "").split(":") or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    into = Path(tempfile.mkdtemp(prefix="xmlframe-ship-"))  # read by the driver's own file server only
    atexit.register(shutil.rmtree, into, True)
    with zipfile.ZipFile(into / "xmlframe_shipped.zip", "w") as out:
        for path in sorted((top / "xmlframe").rglob("*.py")):
            out.write(path, path.relative_to(top))
    context.addPyFile(str(into / "xmlframe_shipped.zip"))

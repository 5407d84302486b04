"""What a session needs besides its configuration."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that they need no copy of their own. Batches of texts go to Python in 8 MB at a time, unless
    the session's configuration names a size."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH):
        spark.conf.set(BATCH, "8m")
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "corpuslake_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one, the same for a session, only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _folders:
            _folders[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
        found = _folders[application]
    return found.rstrip("/")

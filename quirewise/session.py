"""Making the package importable on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quirewise-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def scratch(spark: SparkSession) -> str:
    """A new folder's name inside the folder that driver and executors share (``spark.checkpoint.dir``)."""
    from quirewise.operators.graph import shared_folder

    return f"{shared_folder(spark).rstrip('/')}/quirewise-{uuid.uuid4().hex}"

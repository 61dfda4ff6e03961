"""The package on the executors: its sources as one zip, added to the running application once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, wherever the driver was started. Does nothing the second time."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        path = os.path.join(tempfile.mkdtemp(prefix="memspark-zip-"), "memspark.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(PACKAGE.rglob("*.py")):
                out.write(source, str(source.relative_to(PACKAGE.parent)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark

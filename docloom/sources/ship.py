"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session. The driver serves the file, so it may lie in a folder of its own."""
    if getattr(spark.sparkContext, "_docloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-docloom-")) / "docloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._docloom_shipped = True

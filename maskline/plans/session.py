"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once an application: workers need it wherever they are started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="maskline-")) / "maskline.zip"  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"maskline/{f.relative_to(top)}")
    context.addPyFile(str(path))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":  # the default; documents are long rows, and a batch is held several times over
        spark.conf.set(batch, "1000")
    _shipped.add(context.applicationId)

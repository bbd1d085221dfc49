"""What a session needs before it runs this package's functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once an application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        to = Path(tempfile.mkdtemp(prefix="tidemark-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(str(to.resolve()))
        _shipped.add(app)
    return spark

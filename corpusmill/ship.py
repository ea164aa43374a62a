"""Makes the package importable on executors of any session."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.NamedTemporaryFile(prefix="corpusmill-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out.name)  # executors fetch it from the driver whenever they start
    atexit.register(lambda: os.path.exists(out.name) and os.unlink(out.name))
    _shipped.add(app)

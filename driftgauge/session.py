"""Sessions, and giving the workers this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
_archive: str | None = None
_shipped: set[str] = set()


def archive() -> str:
    """A zip of this package's modules, made once in this process."""
    global _archive
    if _archive is None or not os.path.exists(_archive):
        _archive = os.path.join(tempfile.mkdtemp(), "driftgauge.zip")
        with zipfile.ZipFile(_archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(HERE):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(HERE)))
    return _archive


def ship(spark: SparkSession) -> None:
    """Send the package to the session's workers, so that they import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        sc.addPyFile(archive())
        _shipped.add(sc.applicationId)


def session(name: str = "driftgauge", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster the submitter's settings hold."""
    builder = SparkSession.builder.appName(name).master(f"local[{cpus}]")
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

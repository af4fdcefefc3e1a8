"""Makes this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def prepare_session(spark: SparkSession) -> None:
    """Makes the package importable in the session's Python workers."""
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application.

    The same as submitting with `--py-files`; not needed where it is installed on the
    workers.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    source = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="guardmill-")) / "guardmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(source.rglob("*.py")):
            out.write(file, Path(source.name) / file.relative_to(source))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)

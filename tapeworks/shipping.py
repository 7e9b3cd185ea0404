"""Brings this package to Python workers that don't find it on their own path."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's application, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    out = Path(tempfile.mkdtemp(prefix="tapeworks-zip-")) / "tapeworks.zip"
    out.write_bytes(data.getvalue())
    context.addPyFile(str(out))
    _shipped.add(context.applicationId)

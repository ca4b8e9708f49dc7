"""Python workers of a cluster get this package from the driver: they need not find it on their own path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship() -> None:
    """Send the package to the active session's workers, once; nothing to do without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="meridia-")) / f"{root.name}-core.zip"  # the driver's own; executors fetch it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(spark.sparkContext.applicationId)

"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they run; once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="claimweave-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{here.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(path)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests, benchmarks and small tables."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )

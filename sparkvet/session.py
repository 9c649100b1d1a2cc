"""Makes this package importable on the executors where it is neither installed nor on their path."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Sends the package's source files with the application, once, unless workers inherit a path that has them."""
    app = spark.sparkContext.applicationId
    inherited = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    installed = any("site-packages" in part for part in ROOT.parts)
    if app in _shipped or installed or str(ROOT) in inherited or Path.cwd().resolve() == ROOT:
        return
    archive = Path(tempfile.mkdtemp()) / f"{Path(__file__).parent.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / Path(__file__).parent.name).rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    sys.path_importer_cache.pop(str(archive), None)
    _shipped.add(app)

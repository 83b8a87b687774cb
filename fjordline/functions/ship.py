"""Gets the package to the Python workers when they can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context, once, unless PYTHONPATH (which workers inherit) already holds it."""
    sc = spark.sparkContext
    held = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_ROOT) in held or getattr(sc, "_fjordline_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="fjordline-")) / "fjordline.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((_ROOT / "fjordline").rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    sc.addPyFile(str(path))
    sc._fjordline_shipped = True

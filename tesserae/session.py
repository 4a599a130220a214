"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once for each application.

    Nothing happens where PYTHONPATH already leads to it.
    """
    app = spark.sparkContext.applicationId
    on_path = any(p and Path(p).resolve() == ROOT.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if not on_path and app not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="tesserae-")) / "tesserae.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, f"tesserae/{p.relative_to(ROOT)}")
        spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
    return spark


def build(name: str = "tesserae", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)

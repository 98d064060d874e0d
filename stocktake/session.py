"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH", "")) if x)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("stocktake")
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on executors, once per context, unless
    PYTHONPATH already names its folder."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_stocktake_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="stocktake-")) / "stocktake.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((ROOT / "stocktake").rglob("*.py")):
            archive.write(path, path.relative_to(ROOT))
        for path in sorted(ROOT.glob("corpus_pipeline.py")):
            archive.write(path, path.name)
    context.addPyFile(str(target))
    context._stocktake_shipped = True

"""Session factory: the settings that every query of the engine assumes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What correctness needs (UTC) and what large inputs want (AQE with skew handling).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tamis", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one with the engine's settings; ``conf`` adds to them."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once a context, unless they find it as the driver does.

    They do where its folder is in PYTHONPATH or is the working folder; else Spark serves it to them.
    """
    package = Path(__file__).parent
    root, sc = package.parent, spark.sparkContext
    if getattr(sc, "_tamis_shipped", False):
        return
    sc._tamis_shipped = True
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(root) in {os.path.realpath(p) for p in known if p} | set(known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tamis-"), "tamis.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(root))
    sc.addPyFile(path)

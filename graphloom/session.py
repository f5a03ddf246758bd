"""Session construction and the settings every plan relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that plans in this package assume; all can be changed at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "graphloom", cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with this package's defaults; on a cluster the submit settings win."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    builder = builder.config(map=RUNTIME_CONF).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "12g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once an application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="graphloom-")) / f"{root.name}-{context.applicationId}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time settings that results depend on (never partition counts), and ship the package."""
    ship(spark)
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        if spark.conf.get(key, None) != RUNTIME_CONF[key]:
            spark.conf.set(key, RUNTIME_CONF[key])
    return spark

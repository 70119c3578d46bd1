"""Session settings that the library relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: What a new session gets; a session handed in from outside keeps its own values.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str = "local[*]", app: str = "quern", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for local use; on a cluster spark-submit sets master and sizes."""
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    return prepare(SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate())


#: Rows and bytes that a Python worker gets at once, unless the session says otherwise: texts can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and lets Python workers on this machine import the package, whatever the working directory.

    On a cluster the package is installed on the executors or given with --py-files.
    """
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    home, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *known])
    return spark

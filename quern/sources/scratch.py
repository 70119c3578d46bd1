"""Tables that cut lineage, in the folder that executors and driver share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Masters whose executors are in the driver's own process.
LOCAL = re.compile(r"local(\[[^\]]*\])?")

_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, on one machine (as in tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet and returns it as read back: its lineage ends there and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(path: str, spark: SparkSession) -> None:
    """Counts a folder among those that sweep() removes when the driver ends."""
    _written[path] = spark


def drop(*frames: DataFrame) -> None:
    """Deletes what save() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        for file in df.inputFiles():
            for path in [p for p in _written if file.replace("file:///", "file:/").startswith(p.replace("file:///", "file:/"))]:
                remove(path)


def remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


@atexit.register
def sweep() -> None:
    """Removes what is left when the driver ends."""
    for path in list(_written):
        try:
            remove(path)
        except Exception:  # the JVM may be gone
            _written.pop(path, None)

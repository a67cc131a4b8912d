"""Tables written to the folder that driver and executors share.

All folders are below one of the application's own, which the driver's end removes; `discard` and `remove` give space back earlier.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether an execution's shuffle files go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset: below /tmp/checkpoints if
    everything runs on this machine, as in tests, and an error if not, as executors would write to disks that nobody else reads."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base and not re.fullmatch(r"local(\[[^,]*(,[0-9]+)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/weirflow-{spark.sparkContext.applicationId}"
    path, fs = _path(spark, own)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows, written and read again: a physical copy that outlives executors. The shuffle files of the write go with its end, not when the driver next collects
    its garbage: by then many steps' files would lie on the disks."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that `staged` made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/weirflow-{spark.sparkContext.applicationId}/" in folder:
            remove(spark, folder)

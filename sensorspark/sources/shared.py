"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application and shared folder.
_FOLDERS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir; in a temporary one where none is set and everything runs on this machine, as in tests.

    What is written there is read until the session ends, and goes with it.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    key = (sc.applicationId, known)
    if key not in _FOLDERS:
        folder = f"{known.rstrip('/')}/sensorspark-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: for a result that a plan would otherwise repeat many times."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

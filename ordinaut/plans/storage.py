"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own in ``spark.checkpoint.dir``, which goes when the application ends.  Where that is
    unset, a temporary one in local mode, which has one machine; elsewhere an error, as executors would write where nobody
    else reads."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    key = (spark.sparkContext.applicationId, base)
    if key not in _folders:
        path = f"{base.rstrip('/')}/ordinaut-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _folders[key] = path
    return _folders[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

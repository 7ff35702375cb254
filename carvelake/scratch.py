"""Tables between the rounds of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; it goes when the driver's JVM ends.

    Where the setting is missing, a local master gets a folder of its own; on a cluster that would be another folder on each machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='carvelake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/carvelake-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS.add(root)
    return root


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the scratch folder and reads it back, so a lost executor costs its running tasks only."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables that a later step reads again, in the folder that the driver and all executors share.

That folder is spark.checkpoint.dir.  Where it is unset, a local session uses a temporary folder of its one machine, and a
cluster has none to use.  Everything is under one folder for each application, which goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications, which are deleted as these end.
_OWN: dict[str, str] = {}


def base_folder(spark: SparkSession) -> str:
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    return tempfile.gettempdir()


def application_folder(spark: SparkSession) -> str:
    """The folder of this application, which Spark's JVM deletes when it ends."""
    name = f"lodestrata-{spark.sparkContext.applicationId}"
    base = base_folder(spark)
    if _OWN.get(name) != base:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _OWN[name] = base
    return f"{base}/{name}"


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: no lineage, and it survives lost executors."""
    spark, path = df.sparkSession, f"{application_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files behind tables from written(), once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


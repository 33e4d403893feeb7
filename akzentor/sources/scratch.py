"""Working tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in local mode, in which all executors
    are this machine, and else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="akzentor-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/akzentor-{label}-{uuid.uuid4().hex}"
    atexit.register(discard_path, spark, path)
    return path


def discard_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by now; the folder is scratch space
        return


def discard(df: DataFrame) -> None:
    """Delete a working table made by `keep` that nothing will read again."""
    if path := getattr(df, "_akzentor_path", None):
        discard_path(df.sparkSession, path)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a working table to the shared folder and read it back: lineage ends here and
    survives the loss of executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._akzentor_path = path
    return back

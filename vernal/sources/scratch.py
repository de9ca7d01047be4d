"""Tables written to the folder that the cluster shares, to be read more than once or to cut a long lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. Unset, it is a local folder in local mode and an error on a
    cluster, where a local folder is another disk for each executor."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"/tmp/checkpoints/vernal-{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table; one that is gone already is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may have ended before
        return


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table; it goes when the program ends, or by drop() before (the result's attribute path names it). options are
    those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_drop_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out

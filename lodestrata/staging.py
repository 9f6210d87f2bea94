"""Cutting lineage with written tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, one machine) gets a folder of
    its own; on a cluster that is an error, as executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    own = getattr(context, "_lodestrata_folder", None)
    if own:
        return own
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestrata-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context._lodestrata_folder = own
    return own


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lodestrata/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Delete the staged tables of this application; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table to the shared folder and return a read of it.

    What is read again comes from storage, so a lost executor costs no
    recomputation, and later plans start from known sizes.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

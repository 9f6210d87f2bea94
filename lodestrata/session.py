"""Session helpers: building a session, reading tables, shipping the package."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (one file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    Nothing is done where PYTHONPATH already has it; otherwise a zip of the
    sources goes out once per application through Spark's file server.
    """
    root = str(_PACKAGE.parent)
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    context = spark.sparkContext
    if root in on_path or getattr(context, "_lodestrata_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodestrata-")
    archive = os.path.join(folder, "lodestrata.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    before = list(sys.path)
    context.addPyFile(archive)
    sys.path[:] = before  # the driver keeps importing from the source tree
    context._lodestrata_shipped = True
    atexit.register(shutil.rmtree, folder, ignore_errors=True)

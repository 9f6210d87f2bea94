"""Incremental runs with Structured Streaming.

Every function reads what is there (availableNow), so a run ends by itself and
the next one goes on from its checkpoint. Sinks are idempotent: a batch that
is repeated after a failure overwrites its own partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestrata.functions import text as T
from lodestrata.operators import quality as Q
from lodestrata.staging import stage


def _run(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def first_seen(source: DataFrame, key: str, folder: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen before.

    State grows with the number of keys; with ``event_time`` keys are
    forgotten ``delay`` after the watermark, which bounds it. The batch
    operator is the authority on duplicates farther apart.
    """
    kept = source.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else source.dropDuplicates([key])
    return _run(kept, folder)


def hourly_counts(source: DataFrame, time: str, key: str, folder: str, delay: str = "2 hours") -> DataFrame:
    """Rows by key and hour.

    Each batch writes the windows that it changed; the newest state of a
    window is its result. Windows older than the watermark leave the state, so
    rows that come later than ``delay`` are not counted.
    """
    spark = source.sparkSession
    counted = (
        source.where(F.col(time).isNotNull())
        .withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .groupBy(F.window(time, "1 hour"), key)
        .agg(F.count("*").alias("n"))
        .select(key, F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(f"{counted.schema[key].name} {counted.schema[key].dataType.simpleString()}, hour timestamp_ntz, n bigint, batch int").parquet(f"{folder}/out")
    return written.groupBy(key, "hour").agg(F.max_by("n", "batch").alias("n"))


def gauntlet(source: DataFrame, folder: str, event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """record_id, disposition, shape, reasons of every record once: clean or quarantine.

    Each micro-batch is verified and written to its own partition of the
    routed table. Ids that came before are known from the stream's state, not
    read back from the output; with ``event_time`` the state forgets an id
    ``delay`` after the watermark.
    """
    spark = source.sparkSession
    answer = F.get(F.filter("messages", lambda m: m["role"] == "assistant"), 0)["content"]
    meta = F.col("_meta")
    once = source.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["record_id"]) if event_time else source.dropDuplicates(["record_id"])
    routed = once.select(
        "record_id",
        meta["shape"].alias("shape"),
        Q.verify(F.coalesce(answer, F.lit("")), T.tidy(meta["label"]), F.coalesce(F.get(meta["cwes"], 0), meta["ground_truth_cwe"])).alias("reasons"),
    ).withColumn("disposition", F.when(F.size("reasons") == 0, "clean").otherwise("quarantine"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("disposition").parquet(f"{folder}/out/batch={number}")

    routed.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def once_per_target(targets: DataFrame, key: str, log: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``process`` makes of the targets that the done-log at ``log`` does not hold yet.

    Targets are marked before they are processed, so one that fails is not
    tried again: at most once. The log is a table of keys; targets of a null
    key are left out, repeated ones count once.
    """
    spark = targets.sparkSession
    rows = targets.where(F.col(key).isNotNull()).dropDuplicates([key])
    done = known_keys(spark, log, rows.schema[key])
    todo = stage(rows.join(done, key, "left_anti"), "todo")
    todo.select(key).write.mode("append").parquet(log)
    return process(todo)


def known_keys(spark: SparkSession, path: str, field: StructField) -> DataFrame:
    """Keys of the table at ``path``, none where it does not exist yet."""
    schema = StructType([field])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).select(field.name).distinct()

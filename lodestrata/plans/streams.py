"""Queries that run a stream to its end (availableNow) and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans import duck as D
from lodestrata.plans.quality import _HITS, _VERIFY
from lodestrata.plans.registry import query
from lodestrata.session import read_table, ship_package
from lodestrata.staging import own_folder
from lodestrata.streaming import incremental


def _folder(spark: SparkSession) -> str:
    return f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT DISTINCT event_type FROM events")
def stream_dedup_available_now(spark: SparkSession, d: str) -> DataFrame:
    """First-seen event types of the event stream, by keyed state."""
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(_stream_input(d, "events"))
    return incremental.first_seen(source, "event_type", _folder(spark)).select("event_type")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', ts) IS NOT NULL")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and hour, complete result of a windowed stream."""
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(_stream_input(d, "events"))
    return incremental.hourly_counts(source, "ts", "event_type", _folder(spark))


_EVERY = _HITS.replace("FROM rec WHERE answer IS NOT NULL", "FROM (SELECT * REPLACE (coalesce(answer, '') AS answer) FROM rec)")


@query(D.query(D.REC, _EVERY, _VERIFY, body="SELECT CASE WHEN len(reasons) = 0 THEN 'clean' ELSE 'quarantine' END AS disposition, CAST(count(*) AS BIGINT) AS n FROM verified GROUP BY 1"))
def stream_gauntlet(spark: SparkSession, d: str) -> DataFrame:
    """Records routed to clean and quarantine tables micro-batch by micro-batch; counts by route."""
    ship_package(spark)
    source = spark.readStream.schema(spark.read.parquet(f"{d}/pilot_records.parquet").schema).parquet(_stream_input(d, "pilot_records"))
    return incremental.gauntlet(source, _folder(spark)).groupBy("disposition").count().withColumnRenamed("count", "n")


def _stream_input(d: str, name: str) -> str:
    """A glob that a file stream accepts for one file and for a folder of files alike."""
    return f"{d}/{name}.parque[t]"


@query("SELECT owner_repo, lang, 1 AS run FROM harvest_targets")
def stream_once_per_target(spark: SparkSession, d: str) -> DataFrame:
    """Harvest targets processed in two runs over one done-log: the second run finds nothing to do."""
    targets = read_table(spark, d, "harvest_targets")
    log = f"{_folder(spark)}/done"
    runs = [incremental.once_per_target(targets, "owner_repo", log, lambda df, n=n: df.select("owner_repo", "lang", F.lit(n).alias("run"))) for n in (1, 2)]
    return runs[0].unionByName(runs[1])

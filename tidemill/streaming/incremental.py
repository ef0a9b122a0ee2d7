"""Incremental sync as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.docstore import one_per_key, upsert
from tidemill.plans.declare import Queries, scratch
from tidemill.plans.files import Folder

QUERIES = Queries()


def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync of ``events`` that are purchases has written, all available files taken."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = scratch(spark, "sync")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    chosen = stream.where("event_type = 'purchase'").select("event_id", "user_id")
    query = chosen.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.schema(chosen.schema).parquet(f"{out}/rows")


def sync(stream: DataFrame, out: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand every new batch of a stream to ``write``; the checkpoint under ``out`` makes the next call go on where this one ended."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def last_version(spark: SparkSession, out: str, before: int) -> str | None:
    """The folder of the newest whole state under ``out`` that a batch before this one left."""
    numbers = [int(n.removeprefix("version-")) for n in Folder(spark, out).names() if n.startswith("version-")]
    whole = [n for n in numbers if n < before and "_SUCCESS" in Folder(spark, f"{out}/version-{n}").names()]
    return f"{out}/version-{max(whole)}" if whole else None


def upsert_stream(stream: DataFrame, out: str, key: str, order: str) -> DataFrame:
    """Patch a table of ``key`` with all rows that have arrived, the last by ``order`` of each key; the table as it is then.

    A batch writes the folder of its number from the state before it, which it
    finds in the folder and not in memory: a query that is started again goes
    on from there, and a batch that is run again writes the same. The state
    before the last is kept for that, older ones are deleted.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        last = last_version(spark, out, number)
        changes = one_per_key(batch, key, order)
        state = upsert(spark.read.schema(schema).parquet(last), changes, key) if last else changes
        state.write.mode("overwrite").parquet(f"{out}/version-{number}")
        for name in Folder(spark, out).names():
            if name.startswith("version-") and f"{out}/{name}" not in (last, f"{out}/version-{number}"):
                Folder(spark, out).delete(name)

    sync(stream, out, write)
    newest = last_version(spark, out, 1 << 62)
    return spark.read.schema(schema).parquet(newest) if newest else spark.createDataFrame([], schema)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of users after two arrivals of files with changes; the second call reads the second arrival alone."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    out = scratch(spark, "changes")
    for k in (0, 1):
        events.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{out}/arrived")
        state = upsert_stream(spark.readStream.schema(events.schema).parquet(f"{out}/arrived"), out, "user_id", "event_id")
    return state


QUERIES["stream_upsert"] = stream_upsert
QUERIES.sql["stream_upsert"] = (
    "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, event_id % 2 DESC, event_id DESC"
)
QUERIES["stream_incremental"] = stream_incremental
QUERIES.sql["stream_incremental"] = "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'"

"""Change events (created, updated, deleted) as a stream, in whatever order they come.

The state knows of each key the version of its last event and whether that
deleted it. Keys are dealt into buckets by hash, and the keys of a bucket are
one piece of state, so that a batch reads and writes at most ``BUCKETS``
pieces, however many keys it has. An event that isn't newer than its key's version is dropped,
so late and repeated events change nothing, and a key that was deleted doesn't
come back by an event from before. What remains goes out as rows with their
version; a batch is written to the folder of its number, so a batch that is
run again after a failure replaces its own rows. The checkpoint holds the
state: a query that starts again on it goes on with the same versions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemill.plans.declare import Queries, scratch

QUERIES = Queries()
DELETED = "deleted"
#: Pieces of state. A change of it needs a new checkpoint.
BUCKETS = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestVersion(StatefulProcessor):
    """Lets an event pass that is newer than all events of its key before; ``handleInputRows`` gets the events of many keys."""

    def __init__(self, keys: list[str], version: str, op: str, columns: list[str]):
        self.keys, self.version, self.op, self.columns = keys, version, op, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "keys string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest: dict[str, Row] = {}
        for row in rows:
            name = repr([row[c] + 0.0 if isinstance(row[c], float) else row[c] for c in self.keys])  # no -0.0
            if name not in newest or row[self.version] > newest[name][self.version]:
                newest[name] = row
        known = self.last.get()
        last = json.loads(known[0]) if known else {}
        newer = {name: row for name, row in newest.items() if name not in last or row[self.version] > last[name][0]}
        if newer:
            self.last.update((json.dumps(last | {name: (row[self.version], row[self.op] == DELETED) for name, row in newer.items()}),))
        for row in newer.values():
            yield Row(*self.columns)(*(row[c] for c in self.columns))

    def close(self) -> None:
        pass


def apply_changes(stream: DataFrame, keys: list[str], version: str, op: str, out: str) -> None:
    """Take all events that have arrived, and write what they change under ``out``; events without a key or version are left out."""
    spark = stream.sparkSession
    known = stream.where(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, version)))
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        dealt = known.withColumn("_tm_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
        newest = dealt.groupBy("_tm_bucket").transformWithState(NewestVersion(keys, version, op, stream.columns), outputStructType=stream.schema, outputMode="Update", timeMode="None")
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def current(spark: SparkSession, out: str, schema: StructType, keys: list[str], version: str, op: str) -> DataFrame:
    """The rows that the events have left, without deleted ones."""
    rows = spark.read.schema(schema).parquet(f"{out}/changes/batch=*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), version).alias("_last"))
    return last.select("_last.*").where(F.col(op) != DELETED)


_OP = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END"


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as changes of (user, slot), half of them before a restart and half after it, each half in the order of a hash."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id % 7 AS slot", "event_id AS version", f"{_OP} AS op", "value")
    out, keys = scratch(spark, "change-events"), ["user_id", "slot"]
    for half in (1, 0):
        # each file of an arrival has rows of all times; the newer half of some keys comes first
        events.where(F.pmod(F.xxhash64("version"), F.lit(2)) == half).repartition(F.xxhash64("version", F.lit(1))).write.mode("append").parquet(f"{out}/arrived")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/arrived")
        apply_changes(stream, keys, "version", "op", out)
    return current(spark, out, events.schema, keys, "version", "op")


QUERIES["change_events"] = change_events
QUERIES.sql["change_events"] = f"""SELECT * FROM (SELECT DISTINCT ON (user_id, event_id % 7) user_id, event_id % 7 AS slot, event_id AS version, {_OP} AS op, value
    FROM events ORDER BY user_id, event_id % 7, event_id DESC) WHERE op <> 'deleted'"""

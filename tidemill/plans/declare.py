"""Declaring a query together with the SQL that gives the same rows, and the folders that queries write to on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Queries(dict[str, Query]):
    """Queries by name; ``sql`` has their oracle by the same name."""

    def __init__(self) -> None:
        super().__init__()
        self.sql: dict[str, str] = {}

    def of(self, *tables: str, sql: str | None = None):
        """Declare a function of the named tables."""

        def declare(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

            self[fn.__name__] = run
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return declare


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    Only a session on one machine may lack the setting. On a cluster a folder
    of the driver's own would lose what executors write, so it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of that folder: what is read of it is the same each time, and a lost executor costs a read."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Where tables go: folders of Parquet or JSON lines, appended to or replaced; one small JSON array."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tidemill.plans.declare import Queries, scratch

QUERIES = Queries()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """The table's new state. ``df`` must not read ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A document per line, without its null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def json_array(df: DataFrame, most: int = 10_000) -> str:
    """All rows as one JSON array, for tables of ``most`` rows at most; more are an error, since one process holds them."""
    rows = df.toJSON().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write JSON lines instead")
    return json.dumps([json.loads(r) for r in rows])


@QUERIES.of("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders")
def sink_json_lines(orders: DataFrame) -> DataFrame:
    """What a table of documents holds after it is written and read again."""
    rows = orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status")
    path = scratch(orders.sparkSession, "json-lines")
    write_json_lines(rows, path)
    return orders.sparkSession.read.schema(rows.schema).json(path)


@QUERIES.of("customer", sql="SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, -c_acctbal FROM customer WHERE c_custkey % 2 = 1")
def sink_append(customer: DataFrame) -> DataFrame:
    """Two batches into one table that held something else before."""
    path = scratch(customer.sparkSession, "appended")
    rows = customer.select("c_custkey", "c_acctbal")
    replace(rows.selectExpr("c_custkey", "0D AS c_acctbal"), path)
    replace(rows.where("c_custkey % 2 = 0"), path)
    append(rows.where("c_custkey % 2 = 1").selectExpr("c_custkey", "-c_acctbal AS c_acctbal"), path)
    return customer.sparkSession.read.schema(rows.schema).parquet(path)

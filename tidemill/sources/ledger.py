"""Runs that can be stopped, resumed, reported and rolled back: tables in folders, and a manifest of what counts.

A run writes each batch of a table to a folder of its own. The batch counts
from the moment it is in the manifest, a small file with a line per batch. A
new manifest is a new file with the next number, moved into place in one step
that fails if another writer was first; readers take the highest number. So a
reader sees all of a batch or nothing, a batch whose run died is not seen, and
a lost race is tried again on the newer manifest. Folders that no manifest
names are swept.

The manifest grows with the batches, not with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.plans.declare import Queries, scratch
from tidemill.plans.files import Folder

QUERIES = Queries()
ENTRY = "run string, table_name string, path string, n_rows long, first_key string, last_key string, batch string"
RACES = 50


class Ledger:
    """The runs under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, f"{self.root}/manifest")

    def entries(self) -> list[dict]:
        """The batches that count."""
        return self._latest()[1]

    def _latest(self) -> tuple[int, list[dict]]:
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names() if n.endswith(".json")]
        if not numbers:
            return 0, []
        return max(numbers), [json.loads(line) for line in self.folder.read(f"{max(numbers)}.json").splitlines()]

    def change(self, edit: Callable[[list[dict]], list[dict]]) -> None:
        """Replace the manifest by ``edit`` of it, in one step; on a lost race by ``edit`` of the newer one."""
        for _ in range(RACES):
            number, entries = self._latest()
            text = "\n".join(json.dumps(e, sort_keys=True) for e in edit(entries))
            if self.folder.put_new(f"{number + 1}.json", text):
                return
        raise RuntimeError("the manifest changes faster than it can be written")

    def write(self, run: str, table: str, rows: DataFrame, key: str, batch: str | None = None, replace: bool = False) -> int:
        """Write one batch and make it count; how many rows it has.

        A batch with an id that counts already isn't written again, so a sender
        may repeat it. With ``replace`` it takes the place of all that the table
        had, in the same step.
        """
        sent = lambda entries: next((e["n_rows"] for e in entries if batch is not None and (e["table_name"], e["batch"]) == (table, batch)), None)
        if (n := sent(self.entries())) is not None:
            return n
        path = f"{table}/{run}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        found = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")
        n, first, last = found.agg(F.count("*"), F.min(key).cast("string"), F.max(key).cast("string")).first()
        entry = {"run": run, "table_name": table, "path": path, "n_rows": n, "first_key": first, "last_key": last, "batch": batch}
        others = lambda entries: [e for e in entries if not replace or e["table_name"] != table]
        self.change(lambda entries: entries if sent(entries) is not None else [*others(entries), entry])
        return n

    def read(self, table: str, schema: StructType) -> DataFrame:
        """All rows of a table that count, with ``run``."""
        paths = [e["path"] for e in self.entries() if e["table_name"] == table]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
        name = F.element_at(F.split(F.input_file_name(), "/"), -2)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)).withColumn("run", F.regexp_replace(name, "-[0-9a-f]{32}$", ""))

    def missing(self, table: str, source: DataFrame, key: str) -> DataFrame:
        """The rows of ``source`` whose key doesn't count yet; a row with a null key does where a null is there."""
        there = self.read(table, source.schema).select(F.col(key).alias("_key"))
        return source.join(there, F.col(key).eqNullSafe(F.col("_key")), "left_anti")

    def resume(self, run: str, tables: Iterable[tuple[str, DataFrame, str]]) -> None:
        """Copy what is missing of each (table, source, key), in the order given; nothing is copied twice."""
        for table, source, key in tables:
            rest = self.missing(table, source, key)
            if not rest.isEmpty():
                self.write(run, table, rest, key)

    def rollback(self, run: str) -> None:
        """Take all of a run out again, then its files."""
        self.change(lambda entries: [e for e in entries if e["run"] != run])
        self.sweep()

    def truncate(self, table: str) -> None:
        """An empty table, in one step."""
        self.change(lambda entries: [e for e in entries if e["table_name"] != table])
        self.sweep()

    def sweep(self) -> None:
        """Delete folders that don't count. Not while another run writes: its batch may be on the way."""
        counted = {e["path"] for e in self.entries()}
        tables = Folder(self.spark, self.root)
        for table in (t for t in tables.names() if t != "manifest"):
            for part in Folder(self.spark, f"{self.root}/{table}").names():
                if f"{table}/{part}" not in counted:
                    tables.delete(f"{table}/{part}")

    def batches(self) -> DataFrame:
        """The manifest as rows."""
        return self.spark.createDataFrame([tuple(e[c.split()[0]] for c in ENTRY.split(", ")) for e in self.entries()], ENTRY)

    def report(self) -> DataFrame:
        """``run, table_name, n_batches, n_rows, first_key, last_key``: what each run has done."""
        keys = [F.min_by("first_key", F.expr("try_cast(first_key AS double)")).alias("first_key"), F.max_by("last_key", F.expr("try_cast(last_key AS double)")).alias("last_key")]
        return self.batches().groupBy("run", "table_name").agg(F.count("*").alias("n_batches"), F.sum("n_rows").alias("n_rows"), *keys)


def _halted(customer: DataFrame, orders: DataFrame) -> Ledger:
    """A run of two tables that died: all customers in two batches, part of the orders, and a batch that was written and never counted."""
    ledger = Ledger(orders.sparkSession, scratch(orders.sparkSession, "ledger"))
    for rest in (0, 1):
        ledger.write("run-1", "customer", customer.where(f"c_custkey % 2 = {rest}"), "c_custkey")
    ledger.write("run-1", "orders", orders.where("o_orderkey % 3 = 0"), "o_orderkey")
    orders.where("o_orderkey % 3 = 1").write.parquet(f"{ledger.root}/orders/run-1-{uuid.uuid4().hex}")
    return ledger


def _columns(customer: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    return customer.select("c_custkey", "c_name", "c_nationkey"), orders.select("o_orderkey", "o_custkey", "o_totalprice")


@QUERIES.of("customer", "orders", sql="SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'run-1' ELSE 'run-2' END AS run FROM orders")
def ledger_resume(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """A run that died half way, gone on with by the next: every order once."""
    customer, orders = _columns(customer, orders)
    ledger = _halted(customer, orders)
    ledger.resume("run-2", [("customer", customer, "c_custkey"), ("orders", orders, "o_orderkey")])
    return ledger.read("orders", orders.schema)


@QUERIES.of("customer", "orders", sql="SELECT 'customer' AS table_name, c_custkey AS id FROM customer UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def ledger_rollback(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """The two tables after the second run is rolled back: what the first had done stays."""
    customer, orders = _columns(customer, orders)
    ledger = _halted(customer, orders)
    ledger.resume("run-2", [("customer", customer, "c_custkey"), ("orders", orders, "o_orderkey")])
    ledger.rollback("run-2")
    rows = [ledger.read(t, df.schema).select(F.lit(t).alias("table_name"), F.col(k).alias("id")) for t, df, k in (("customer", customer, "c_custkey"), ("orders", orders, "o_orderkey"))]
    return rows[0].union(rows[1])


@QUERIES.of(
    "customer", "orders",
    sql="""SELECT 'run-1' AS run, 'customer' AS table_name, 2 AS n_batches, count(*) AS n_rows, CAST(min(c_custkey) AS VARCHAR) AS first_key, CAST(max(c_custkey) AS VARCHAR) AS last_key FROM customer
    UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'run-1' ELSE 'run-2' END, 'orders', 1, count(*), CAST(min(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR) FROM orders GROUP BY 1""",
)
def ledger_report(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """What the two runs did."""
    customer, orders = _columns(customer, orders)
    ledger = _halted(customer, orders)
    ledger.resume("run-2", [("customer", customer, "c_custkey"), ("orders", orders, "o_orderkey")])
    return ledger.report()


@QUERIES.of("orders", sql="SELECT o_orderkey, o_custkey, o_totalprice, 'run-2' AS run FROM orders WHERE o_orderkey % 4 = 3 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'run-3' FROM orders WHERE o_orderkey % 4 = 1")
def sink_transactions(orders: DataFrame) -> DataFrame:
    """A table after a truncation, a batch that was sent twice, one that failed half way, and a replacement followed by another batch."""
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    ledger = Ledger(orders.sparkSession, scratch(orders.sparkSession, "ledger"))
    ledger.write("run-1", "orders", orders, "o_orderkey")
    ledger.truncate("orders")
    for _ in range(2):
        ledger.write("run-1", "orders", orders.where("o_orderkey % 4 = 2"), "o_orderkey", batch="7")
    ledger.write("run-2", "orders", orders.where("o_orderkey % 4 = 3"), "o_orderkey", replace=True)
    broken = orders.where("o_orderkey % 4 = 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 32 == 0, F.raise_error(F.lit("broken row"))).otherwise(F.col("o_custkey")).cast("long"))
    try:
        ledger.write("run-2", "orders", broken, "o_orderkey")
    except Exception as error:
        if "broken row" not in str(error):
            raise
    ledger.write("run-3", "orders", orders.where("o_orderkey % 4 = 1"), "o_orderkey", batch="8")
    return ledger.read("orders", orders.schema)

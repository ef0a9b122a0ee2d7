"""A migration from end to end: tables in order of their links, projected, written in parts, verified; it can be stopped and gone on with.

Each table becomes documents by its projection, with links resolved against
the parents' rows, and is written in ``parts`` by a hash of the document id. A
part counts in one step (see the ledger), so a run that dies leaves whole
parts, and the next run writes those that are missing and no others. Rows that
can't be converted, or lack a parent they need, go to a table of their own with
the names of the fields. Verification compares the documents with what counts,
by checksums of key ranges, and reads every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import DRIVER, Catalog, Table
from tidemill.operators.advice import preflight
from tidemill.operators.checksums import verify_ranges
from tidemill.operators.graph import levels
from tidemill.operators.projection import Projection
from tidemill.operators.verify import summary
from tidemill.plans.declare import Queries, scratch
from tidemill.sources.ledger import Ledger

QUERIES = Queries()
KEY = "_id"
REJECTED = "__rejected"


@dataclass
class Migration:
    """What goes where: frames by table, the catalog that says how they are linked, and the folder of the target."""

    spark: SparkSession
    source: dict[str, DataFrame]
    catalog: Catalog
    root: str
    projections: dict[str, Projection] = field(default_factory=dict)
    parts: int = 4

    def __post_init__(self) -> None:
        self.ledger = Ledger(self.spark, self.root)

    def order(self) -> list[tuple[str, int]]:
        """(table, level): parents before children; tables on a cycle come last, on a level of their own."""
        known = levels(self.catalog.edges(), self.source)
        last = max(known.values(), default=-1) + 1
        return sorted(((t, known.get(t, last)) for t in self.source), key=lambda x: (x[1], x[0]))

    def documents(self, table: str) -> DataFrame:
        """All documents of a table, those with errors too."""
        rule = self.projections.get(table) or Projection(self.catalog.tables.get(table) or Table(table))
        return rule.documents(self.source[table], {t: df for t, df in self.source.items() if t != table})

    def _split(self, table: str) -> tuple[DataFrame, DataFrame]:
        made = self.documents(table)
        return made.where(F.size("_errors") == 0).drop("_errors"), made.where(F.size("_errors") > 0).select(KEY, "_errors")

    def run(self, run: str, tables: Iterable[str] | None = None, on_part: Callable[[str, int, int], None] | None = None) -> None:
        """Write what is missing of the tables, or of all, in order; ``on_part`` hears of each part that counts: its table, number and rows."""
        chosen = set(self.source if tables is None else tables)
        for table, _ in self.order():
            if table not in chosen:
                continue
            good, bad = self._split(table)
            part = F.pmod(F.xxhash64(KEY), F.lit(self.parts))
            for i in range(self.parts):
                n = self.ledger.write(run, table, good.where(part == i), KEY, batch=f"{table}/{i} of {self.parts}")
                if on_part:
                    on_part(table, i, n)
            self.ledger.write(run, table + REJECTED, bad, KEY, batch=f"{table}/rejected")

    def target(self, table: str) -> DataFrame:
        """The documents that count."""
        return self.ledger.read(table, self._split(table)[0].schema).drop("run")

    def rejected(self, table: str) -> DataFrame:
        return self.ledger.read(table + REJECTED, self._split(table)[1].schema).drop("run")

    def verify(self, table: str) -> DataFrame:
        """One row: how many documents are equal, different, missing and extra, and the verdict."""
        good = self._split(table)[0]
        return summary(verify_ranges(good, self.target(table), KEY, [c for c in good.columns if c != KEY]))

    def report(self) -> DataFrame:
        """``table_name, level, n_source, n_rejected, n_equal, n_different, n_missing, n_extra, matches``, a row for each table."""
        rows = []
        for table, level in self.order():
            counts = self.source[table].agg(F.count("*").alias("n_source")).crossJoin(self.rejected(table).agg(F.count("*").alias("n_rejected")))  # a row each
            rows.append(counts.crossJoin(self.verify(table).drop("advice")).select(F.lit(table).alias("table_name"), F.lit(level).alias("level"), "*"))
        return reduce(DataFrame.unionByName, rows)

    def dry_run(self) -> DataFrame:
        """What a run would do: rows, batches, seconds and bytes of each table, with its level; nothing is written."""
        counts = reduce(DataFrame.union, (df.agg(F.count("*")).select(F.lit(t).alias("table_name"), F.col("count(1)").alias("n_rows")) for t, df in self.source.items()))
        order = self.spark.createDataFrame(self.order(), "table_name string, level int")
        return preflight(counts).join(F.broadcast(order), "table_name")  # a row for each table


def _of(spark: SparkSession, sf_dir: str) -> Migration:
    """Orders with all that they need; customers of a few segments aren't there, so their orders lose the link."""
    catalog = DRIVER.chosen(["orders"])
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in catalog.tables}
    frames["customer"] = frames["customer"].where("c_mktsegment <> 'BUILDING'")
    return Migration(spark, frames, catalog, scratch(spark, "migration"))


def migration_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that are there after a run that ended with the customers, and the one that went on."""
    migration = _of(spark, sf_dir)
    migration.run("run-1", ["region", "nation", "customer"])
    migration.run("run-2")
    return migration.target("orders")


def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification says while the orders are still missing."""
    migration = _of(spark, sf_dir)
    migration.run("run-1", ["region", "nation", "customer"])
    return migration.report()


def migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir).dry_run().select("table_name", "level", "n_rows", "batches")


_ID = "lpad(lower(to_hex({})), 16, '0')"
_COUNTS = "SELECT 'region' AS table_name, 0 AS level, count(*) AS n FROM region UNION ALL SELECT 'nation', 1, count(*) FROM nation UNION ALL SELECT 'customer', 2, count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'orders', 3, count(*) FROM orders"
for _run, _sql in (
    (migration_documents, f"""SELECT 'orders:' || {_ID.format("o_orderkey")} AS _id, 'customer:' || {_ID.format("c_custkey")} AS "oCustkey", o_orderstatus AS "oOrderstatus", o_totalprice AS "oTotalprice",
        epoch_us(o_orderdate) // 1000 AS "oOrderdate", o_orderpriority AS "oOrderpriority" FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey"""),
    (migration_report, f"""SELECT table_name, level, n AS n_source, 0 AS n_rejected, CASE WHEN level < 3 THEN n ELSE 0 END AS n_equal, 0 AS n_different, CASE WHEN level = 3 THEN n ELSE 0 END AS n_missing, 0 AS n_extra, level < 3 AS matches FROM ({_COUNTS})"""),
    (migration_plan, f"SELECT table_name, level, n AS n_rows, CAST(ceil(n / 100.0) AS BIGINT) AS batches FROM ({_COUNTS})"),
):
    QUERIES[_run.__name__] = _run
    QUERIES.sql[_run.__name__] = _sql

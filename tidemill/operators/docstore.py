"""Document queries per table: get, list, lookup, search, upsert, sweeps. Changes give the new full state."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.scans import keyset_page
from tidemill.plans.declare import Queries

QUERIES = Queries()


def one_per_key(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Changes with a key, one for each: the last by ``order``, or else the greatest by all columns, which is the same in every run."""
    others = [c for c in changes.columns if c != key]
    rank = F.struct(*([F.col(order).alias("_order")] if order else []), *others)
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(rank).alias("_last"))
    return last.select(*(F.col(key) if c == key else F.col(f"_last.{c}") for c in changes.columns))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table with matching rows patched and the others of ``changes`` added; one exchange by key for either side.

    A field that ``changes`` lacks, or has as null, keeps its value. Changes
    without a key are left out, since nothing can find their row again; of
    several with one key the last by ``order`` counts.
    """
    new = one_per_key(changes, key, order)
    new = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    fields = [F.coalesce(key, "_key").alias(key) if c == key else (F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c)) for c in table.columns]
    return table.join(new, F.col(key) == F.col("_key"), "full").select(*fields)


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with matching rows patched; changes that match no row do nothing."""
    new = one_per_key(changes, key)
    new = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    fields = [F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in table.columns]
    return table.join(new, F.col(key) == F.col("_key"), "left").select(*fields)


def create(table: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """The table with new rows, of which the named fields are taken."""
    return table.unionByName(rows.select(*fields), allowMissingColumns=True)


def remove(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table without the rows of these ids."""
    return table.join(ids.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def find(table: DataFrame, **values) -> DataFrame:
    """Rows that have all of the values; no values mean all rows, null means null."""
    return table.where(reduce(and_, (F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()), F.lit(True)))


def unique(table: DataFrame, **values) -> DataFrame:
    """The one row, or none, that has the values; several are an error when the result is read."""
    found = find(table, **values).limit(2)
    counted = found.agg(F.count("*").alias("_n"), F.any_value(F.struct("*")).alias("_row"))
    checked = counted.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("several rows are found where one is expected")).cast("boolean")).otherwise(F.col("_n") == 1))
    return checked.select("_row.*")


def exists(table: DataFrame, **values) -> DataFrame:
    return find(table, **values).limit(1).agg((F.count("*") > 0).alias("found"))


def page(table: DataFrame, key: str, before=None, size: int = 50) -> DataFrame:
    """The newest ``size`` rows, or those before a key, with ``next``: the key to go on before, null on the last page."""
    rows = keyset_page(table, [key], None if before is None else [before], size + 1, descending=True)
    spot = Window.orderBy(F.desc(key))  # a page, not the table
    numbered = rows.withColumns({"_n": F.row_number().over(spot), "_all": F.count("*").over(Window.partitionBy())})
    last = F.max(F.when(F.col("_n") == size, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next", F.when(F.col("_all") > size, last)).where(F.col("_n") <= size).drop("_n", "_all")


def search(table: DataFrame, field: str, text: str, size: int = 20, key: str | None = None) -> DataFrame:
    """The rows with most of the words of ``text`` in a field, ``score`` words of it; a top-k."""
    words = sorted(set(re.findall(r"\w+", text.lower())))
    score = reduce(add, (F.lower(field).rlike(rf"(?<!\w){re.escape(w)}(?!\w)").cast("int") for w in words), F.lit(0))
    found = table.withColumn("score", F.coalesce(score, F.lit(0))).where("score > 0")
    return found.orderBy(F.desc("score"), *([key] if key else [])).limit(size)


def expired(table: DataFrame, column: str, now: Column, status: tuple[str, str] | None = None, size: int = 500, key: str | None = None) -> DataFrame:
    """A batch of rows whose time lies before ``now``, of one status if given; oldest first."""
    late = F.col(column) < now
    return table.where(late & (F.col(status[0]) == status[1]) if status else late).orderBy(column, *([key] if key else [])).limit(size)


@QUERIES.of("customer", sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def doc_get(customer: DataFrame) -> DataFrame:
    return unique(customer.select("c_custkey", "c_name"), c_custkey=42)


@QUERIES.of("orders", sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def doc_get_by(orders: DataFrame) -> DataFrame:
    return find(orders, o_custkey=7).select("o_orderkey", "o_orderstatus")


@QUERIES.of("documents", sql="SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def doc_search(documents: DataFrame) -> DataFrame:
    return documents.where(F.lower("text").contains("license")).select("doc_id")


@QUERIES.of("orders", sql="SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def doc_count(orders: DataFrame) -> DataFrame:
    return orders.where("o_totalprice > 1000").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@QUERIES.of(
    "orders",
    sql="""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
    UNION ALL SELECT -o_orderkey - 1, 'N', NULL FROM orders WHERE o_orderkey % 100 = 0""",
)
def doc_upsert(orders: DataFrame) -> DataFrame:
    """Changes with repeated keys, without a key, without a price, and with null where the old value stays."""
    rows = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    change = lambda where, key, status: orders.where(where).select(F.expr(key).cast("long").alias("o_orderkey"), F.expr(status).cast("string").alias("o_orderstatus"))
    changes = [change("o_orderkey % 10 = 0", "o_orderkey", "'X'"), change("o_orderkey % 10 = 0", "o_orderkey", "'Y'"), change("o_orderkey % 7 = 1", "NULL", "'Z'")]
    changes += [change("o_orderkey % 100 = 0", "-o_orderkey - 1", "'N'"), change("o_orderkey % 10 = 3", "o_orderkey", "NULL")]
    return upsert(rows, reduce(DataFrame.union, changes), "o_orderkey")


@QUERIES.of("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def doc_update(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    patch = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return update(rows, patch.union(patch.selectExpr("-o_orderkey - 1", "'W'", "0D")), "o_orderkey")


@QUERIES.of("customer", "supplier", sql="SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT -s_suppkey, s_name, NULL FROM supplier")
def doc_create(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    new = supplier.select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return create(customer.select("c_custkey", "c_name", "c_acctbal"), new, ["c_custkey", "c_name"])


@QUERIES.of("orders", sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 9 <> 0")
def doc_remove(orders: DataFrame) -> DataFrame:
    return remove(orders.select("o_orderkey", "o_orderstatus"), orders.where("o_orderkey % 9 = 0"), "o_orderkey")


@QUERIES.of("orders", sql="SELECT o_orderkey, o_totalprice, (SELECT min(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey < 900 ORDER BY 1 DESC LIMIT 50)) AS next FROM orders WHERE o_orderkey < 900 ORDER BY 1 DESC LIMIT 50")
def doc_list_page(orders: DataFrame) -> DataFrame:
    return page(orders.select("o_orderkey", "o_totalprice"), "o_orderkey", before=900)


@QUERIES.of("orders", sql="SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def doc_find_by(orders: DataFrame) -> DataFrame:
    return find(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), o_custkey=7, o_orderstatus="O")


@QUERIES.of("customer", sql="SELECT c_custkey, c_name FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 11)")
def doc_unique(customer: DataFrame) -> DataFrame:
    name = customer.where("c_custkey = 11").first()["c_name"]
    return unique(customer.select("c_custkey", "c_name"), c_name=name)


@QUERIES.of("orders", sql="SELECT true AS found UNION ALL SELECT false")
def doc_exists(orders: DataFrame) -> DataFrame:
    return exists(orders, o_orderstatus="F").union(exists(orders, o_orderstatus="no such"))


@QUERIES.of(
    "documents",
    sql=r"""SELECT doc_id, score FROM (SELECT doc_id, CAST(regexp_matches(lower(text), '(^|\W)license(\W|$)') AS INT) + CAST(regexp_matches(lower(text), '(^|\W)apache(\W|$)') AS INT) AS score
    FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""",
)
def doc_search_scored(documents: DataFrame) -> DataFrame:
    return search(documents.select("doc_id", "text"), "text", "Apache license", key="doc_id").select("doc_id", "score")


@QUERIES.of("orders", "customer", sql="SELECT o_orderkey FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON o_custkey = c_custkey")
def doc_batch_remove(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return orders.join(customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


def _at(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


@QUERIES.of("events", sql="SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 100")
def sweep_expired(events: DataFrame) -> DataFrame:
    return expired(events, "ts", _at("2024-01-10 00:00:00"), size=100, key="event_id").select("event_id")


@QUERIES.of("orders", sql="SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 30 DAY ORDER BY o_orderdate, o_orderkey LIMIT 500")
def sweep_soft_deleted(orders: DataFrame) -> DataFrame:
    """Rows that were marked as deleted 30 days ago or longer."""
    return expired(orders, "o_orderdate", _at("1996-01-01 00:00:00") - F.expr("interval 30 days"), ("o_orderstatus", "F"), key="o_orderkey").select("o_orderkey")


@QUERIES.of("orders", sql="SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' - INTERVAL 90 DAY ORDER BY o_orderdate, o_orderkey LIMIT 500")
def sweep_aged(orders: DataFrame) -> DataFrame:
    return expired(orders, "o_orderdate", _at("1995-06-01 00:00:00") - F.expr("interval 90 days"), key="o_orderkey").select("o_orderkey")


@QUERIES.of("orders", sql="SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def reset_stuck(orders: DataFrame) -> DataFrame:
    """Work that has been pending for too long is open again."""
    stuck = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < _at("1996-01-01 00:00:00"))
    return orders.select("o_orderkey", F.when(stuck, "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))

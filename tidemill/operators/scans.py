"""Scans: pages by key or offset, filters that reach the reader, counts, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries

QUERIES = Queries()


def keyset_page(df: DataFrame, keys: list[str], after: list | None, size: int, descending: bool = False) -> DataFrame:
    """The ``size`` rows that follow the key values ``after``; a top-k, not a sort of the table."""
    if after is not None:
        ties: Column = F.lit(True)
        terms = []
        for key, value in zip(keys, after, strict=True):
            beyond = F.col(key) < value if descending else F.col(key) > value
            terms.append(ties & beyond)
            ties = ties & (F.col(key) == value)
        df = df.where(reduce(lambda a, b: a | b, terms))
    return df.orderBy(*(F.desc(k) if descending else F.asc(k) for k in keys)).limit(size)


def page_with_end(df: DataFrame, keys: list[str], after: list | None, size: int) -> DataFrame:
    """``keyset_page`` with ``more``: whether rows follow. One row more than the page is read to know."""
    rows = keyset_page(df, keys, after, size + 1)
    here = Window.orderBy(*keys)  # a page, not the table
    return rows.withColumns({"_n": F.row_number().over(here), "more": F.count("*").over(Window.partitionBy()) > size}).where(F.col("_n") <= size).drop("_n")


def empty_as_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in columns})


@QUERIES.of("orders", sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 50")
def scan_keyset_page(orders: DataFrame) -> DataFrame:
    return keyset_page(orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], [100], 50)


@QUERIES.of("nation", sql="SELECT n_nationkey, n_name, false AS more FROM nation WHERE n_nationkey > 14 ORDER BY 1 LIMIT 10")
def scan_last_page(nation: DataFrame) -> DataFrame:
    """The last page is full, and still known to be the last."""
    return page_with_end(nation.select("n_nationkey", "n_name"), ["n_nationkey"], [14], 10)


@QUERIES.of("orders", sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 900 ORDER BY 1 DESC LIMIT 50")
def scan_keyset_desc(orders: DataFrame) -> DataFrame:
    return keyset_page(orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], [900], 50, descending=True)


@QUERIES.of("conversations", sql="SELECT conv_id, turn, role FROM conversations WHERE conv_id > 3 OR (conv_id = 3 AND turn > 0) ORDER BY 1, 2 LIMIT 40")
def scan_keyset_composite(conversations: DataFrame) -> DataFrame:
    return keyset_page(conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"], [3, 0], 40)


@QUERIES.of("customer", sql="SELECT c_custkey, c_name FROM customer ORDER BY 1 LIMIT 20 OFFSET 40")
def scan_offset_page(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", "c_name").orderBy("c_custkey").offset(40).limit(20)


@QUERIES.of("lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def scan_where_pushdown(lineitem: DataFrame) -> DataFrame:
    return lineitem.where("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@QUERIES.of("events", sql="SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def scan_incremental_since(events: DataFrame) -> DataFrame:
    return events.where(F.col("ts") > F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("event_id", "user_id", "event_type")


@QUERIES.of("customer", sql="SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 25")
def scan_sample_hashed(customer: DataFrame) -> DataFrame:
    """A sample that is the same in every run."""
    return customer.select("c_custkey", "c_name").orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey").limit(25)


@QUERIES.of("orders", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def scan_top_k(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@QUERIES.of(*TABLES, sql=" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def count_tables(*tables: DataFrame) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in zip(TABLES, tables, strict=True)]
    return reduce(DataFrame.unionByName, counts)


@QUERIES.of("part", sql="SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def null_empty_string(part: DataFrame) -> DataFrame:
    blanks = part.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("brand"))
    return empty_as_null(blanks, "brand")

"""Document ids from keys, and foreign keys resolved by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.converters import epoch_ms
from tidemill.operators.masking import hashed
from tidemill.plans.declare import Queries

QUERIES = Queries()


def doc_id(table: str, key: str | Column) -> Column:
    """``table:<16 hex digits>``: the same in every run, so no id map has to be kept."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{table}:"), F.lpad(F.lower(F.hex(key)), 16, "0"))


def resolve(child: DataFrame, column: str, parent: DataFrame, key: str, table: str, name: str) -> DataFrame:
    """The child's rows with the document id of their parent; null where there is none."""
    return child.join(parent.select(F.col(key).alias("_parent")), F.col(column) == F.col("_parent"), "left").withColumn(name, doc_id(table, "_parent")).drop("_parent")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_parent")), F.col(column) == F.col("_parent"), "left_anti")


@QUERIES.of(
    "orders", "customer",
    sql="""SELECT 'orders:' || lpad(lower(to_hex(o.o_orderkey)), 16, '0') AS doc_id,
    'customer:' || lpad(lower(to_hex(c.c_custkey)), 16, '0') AS "oCustkey", o.o_orderstatus AS "oOrderstatus",
    o.o_totalprice AS "oTotalprice", epoch_us(o.o_orderdate) // 1000 AS "oOrderdate", sha256(c.c_name || 'seed') AS "customerNameHash"
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey > 100""",
)
def project_document_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    joined = orders.where("o_orderkey > 100").join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        doc_id("orders", "o_orderkey").alias("doc_id"), doc_id("customer", "c_custkey").alias("oCustkey"), F.col("o_orderstatus").alias("oOrderstatus"),
        F.col("o_totalprice").alias("oTotalprice"), epoch_ms("o_orderdate").alias("oOrderdate"), hashed("c_name", "seed").alias("customerNameHash"),
    )


@QUERIES.of("customer", sql="""SELECT 'customer:' || lpad(lower(to_hex(c_custkey)), 16, '0') AS doc_id, c_name AS "cName", CAST(c_nationkey AS DOUBLE) AS "cNationkey" FROM customer""")
def project_document_customer(customer: DataFrame) -> DataFrame:
    return customer.select(doc_id("customer", "c_custkey").alias("doc_id"), F.col("c_name").alias("cName"), F.col("c_nationkey").cast("double").alias("cNationkey"))


_KEPT = "SELECT * FROM customer WHERE c_custkey % 7 <> 0"


@QUERIES.of("orders", "customer", sql=f"SELECT o_orderkey, 'customer:' || lpad(lower(to_hex(c_custkey)), 16, '0') AS customer_id FROM orders LEFT JOIN ({_KEPT}) ON o_custkey = c_custkey")
def fk_resolve_optional(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return resolve(orders.select("o_orderkey", "o_custkey"), "o_custkey", customer.where("c_custkey % 7 <> 0"), "c_custkey", "customer", "customer_id").drop("o_custkey")


@QUERIES.of("orders", "customer", sql=f"SELECT o_orderkey, o_custkey FROM orders ANTI JOIN ({_KEPT}) c ON o_custkey = c_custkey")
def fk_orphans(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return orphans(orders.select("o_orderkey", "o_custkey"), "o_custkey", customer.where("c_custkey % 7 <> 0"), "c_custkey")


@QUERIES.of(
    "orders", "customer",
    sql=f"SELECT count(*) AS n_rows, count(c_custkey) AS n_resolved, count(*) - count(c_custkey) AS n_orphans FROM orders LEFT JOIN ({_KEPT}) ON o_custkey = c_custkey",
)
def fk_integrity_report(orders: DataFrame, customer: DataFrame) -> DataFrame:
    joined = orders.join(customer.where("c_custkey % 7 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.agg(F.count("*").alias("n_rows"), F.count("c_custkey").alias("n_resolved"), (F.count("*") - F.count("c_custkey")).alias("n_orphans"))


@QUERIES.of("orders", "customer", "nation", sql="SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def expand_relations(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


def linked_pairs(junction: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right, left_id, right_id``: each pair of links that a row of a junction makes, every pair of columns once."""
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("long").alias("left_id"), F.col(b).cast("long").alias("right_id")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return junction.select(F.inline(F.array(*pairs))).where("left_id is not null and right_id is not null").distinct()


@QUERIES.of("lineitem", sql=" UNION ALL ".join(f"SELECT DISTINCT '{a}' AS left, '{b}' AS right, {a} AS left_id, {b} AS right_id FROM lineitem" for a, b in (("l_orderkey", "l_partkey"), ("l_orderkey", "l_suppkey"), ("l_partkey", "l_suppkey"))))
def junction_pairs(lineitem: DataFrame) -> DataFrame:
    return linked_pairs(lineitem, ["l_orderkey", "l_partkey", "l_suppkey"])


@QUERIES.of("orders", "customer", sql=f"SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'o_custkey' END AS error FROM orders LEFT JOIN ({_KEPT}) ON o_custkey = c_custkey")
def fk_resolve_required(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """A link that may not be missing: the row stays, and says what it lacks."""
    found = resolve(orders.select("o_orderkey", "o_custkey"), "o_custkey", customer.where("c_custkey % 7 <> 0"), "c_custkey", "customer", "customer_id")
    return found.select("o_orderkey", F.when(F.col("customer_id").isNull(), "o_custkey").alias("error"))


@QUERIES.of("customer", sql="SELECT c.c_custkey, 'customer:' || lpad(lower(to_hex(p.c_custkey)), 16, '0') AS manager_id FROM customer c LEFT JOIN customer p ON p.c_custkey = CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE c.c_custkey * 2 END")
def fk_self_ref(customer: DataFrame) -> DataFrame:
    """A table that refers to itself, also to rows that come later, to none, and to ones that aren't there."""
    rows = customer.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") * 2).alias("manager"))
    return resolve(rows, "manager", customer, "c_custkey", "customer", "manager_id").drop("manager")


@QUERIES.of("customer", "supplier", sql="SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return customer.select(F.col("c_nationkey").alias("nation")).union(supplier.select("s_nationkey")).distinct()


@QUERIES.of("customer", "orders", sql="SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def set_difference(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.select("c_custkey").subtract(orders.where("o_totalprice > 250000").select("o_custkey"))


@QUERIES.of("orders", sql="SELECT o_orderkey % 50 AS k FROM orders EXCEPT ALL SELECT o_orderkey % 40 FROM orders")
def set_difference_all(orders: DataFrame) -> DataFrame:
    """With repeats: what one side has more often."""
    return orders.select((F.col("o_orderkey") % 50).alias("k")).exceptAll(orders.select(F.col("o_orderkey") % 40))

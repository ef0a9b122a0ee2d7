"""Aggregates and running computations over rows and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries, written

QUERIES = Queries()


def dealt_in_order(df: DataFrame, *order: str, rows: int | None = None) -> DataFrame:
    """The rows as a written table with ``_range``, the number of the range of ``order`` a row fell into.

    Ranges are dealt once: were they dealt again, by another plan that reads
    fewer columns, adaptive execution could merge them otherwise. Rows that
    are equal by ``order`` are told apart by a hash of the others, ``_tie``,
    so that one frequent key doesn't make a range. ``rows`` is about how many
    are in a range, where a task holds one whole; otherwise Spark chooses.
    """
    tie = F.xxhash64(*(c for c, kind in df.dtypes if c not in order and "map<" not in kind), F.lit(0))
    ranges = (1 + df.count() // rows,) if rows else ()
    return written(df.withColumn("_tie", tie).repartitionByRange(*ranges, *order, "_tie").withColumn("_range", F.spark_partition_id()), "dealt")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """The rows with ``batch``, their number in order of ``key`` in runs of ``size``, and ``is_last`` for the last row.

    Ranks don't come from one window over the table: rows are dealt out by
    ranges of the key and written, counted per range, and ranked within. Rows
    with the same key, null included, which comes first, are in one order
    whatever the partitions; rows equal in all columns are alike.
    """
    dealt = dealt_in_order(df, key)
    ranks = Window.partitionBy("_range").orderBy(key, "_tie")
    # a row per range, so this window is small whatever the table
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = dealt.withColumn("_rank", F.row_number().over(ranks)).join(F.broadcast(starts), "_range").withColumn("_place", F.col("_before") + F.col("_rank"))
    return placed.select(*df.columns, F.floor((F.col("_place") - 1) / size).cast("long").alias("batch"), (F.col("_place") == F.col("_all")).alias("is_last"))


def document_bytes(df: DataFrame) -> Column:
    """Bytes of a row as a JSON document, null fields left out."""
    return F.octet_length(F.to_json(F.struct(*df.columns)))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, whole."""
    rank = F.struct(*order, *(c for c in df.columns if c not in order))
    return df.groupBy(*keys).agg(F.min(rank).alias("_first")).select(*(F.col(f"_first.{c}") for c in df.columns))


def tracked(df: DataFrame, table: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each table, such as a rollback keeps."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(table).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def latest_versions(*maps: DataFrame, keys: list[str]) -> DataFrame:
    """The union of id maps; of several entries for one key that of the last map counts."""
    numbered = [m.withColumn("_version", F.lit(i)) for i, m in enumerate(maps)]
    every = numbered[0]
    for m in numbered[1:]:
        every = every.unionByName(m)
    others = [c for c in every.columns if c not in (*keys, "_version")]
    last = every.groupBy(*keys).agg(F.max(F.struct("_version", *others)).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}") for c in others))


@QUERIES.of("orders", sql="SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch, row_number() OVER (ORDER BY o_orderkey DESC) = 1 AS is_last FROM orders")
def batch_numbering(orders: DataFrame) -> DataFrame:
    return batches(orders.select("o_orderkey"), "o_orderkey", 100)


@QUERIES.of("documents", sql="SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch, row_number() OVER (ORDER BY doc_id DESC) = 1 AS is_last FROM documents")
def batch_documents(documents: DataFrame) -> DataFrame:
    """Whole rows in numbered batches."""
    return batches(documents, "doc_id", 100)


@QUERIES.of("customer", sql="""SELECT c_custkey, length('{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',"c_name":"' || c_name || '"' END || '}') AS n_bytes FROM customer""")
def document_sizes(customer: DataFrame) -> DataFrame:
    df = customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).alias("c_name"))
    return df.select("c_custkey", document_bytes(df).cast("long").alias("n_bytes"))


@QUERIES.of("orders", sql="SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def dedupe(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return first_rows(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@QUERIES.of("orders", sql="SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 25")
def capped_tracking(orders: DataFrame) -> DataFrame:
    return tracked(orders.select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 25)


_MAP = "SELECT 'customer' AS table_name, c_custkey AS source_id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part"


def _id_map(customer: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    rows = [df.select(F.lit(t).alias("table_name"), F.col(k).alias("source_id")) for t, k, df in (("customer", "c_custkey", customer), ("supplier", "s_suppkey", supplier), ("part", "p_partkey", part))]
    return rows[0].union(rows[1]).union(rows[2])


@QUERIES.of("customer", "supplier", "part", sql=f"SELECT table_name, count(*) AS n, min(source_id) AS first_id, max(source_id) AS last_id FROM ({_MAP}) GROUP BY 1")
def id_map_stats(customer: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    stats = [F.count("*").alias("n"), F.min("source_id").alias("first_id"), F.max("source_id").alias("last_id")]
    return _id_map(customer, supplier, part).groupBy("table_name").agg(*stats)


@QUERIES.of("customer", "supplier", "part", sql=f"SELECT table_name, source_id, CASE WHEN table_name = 'customer' AND source_id % 2 = 0 THEN 'new' ELSE 'old' END AS target FROM ({_MAP}) UNION ALL SELECT 'customer', -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 50 = 0")
def id_map_merge(customer: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    old = _id_map(customer, supplier, part).withColumn("target", F.lit("old"))
    changed = customer.where("c_custkey % 2 = 0").selectExpr("'customer' AS table_name", "c_custkey AS source_id", "'new' AS target")
    added = customer.where("c_custkey % 50 = 0").selectExpr("'customer' AS table_name", "-c_custkey - 1 AS source_id", "'new' AS target")
    return latest_versions(old, changed.union(added), keys=["table_name", "source_id"])


@QUERIES.of("customer", "supplier", "part", sql=f"SELECT * FROM ({_MAP}) WHERE table_name IN ('part', 'supplier')")
def id_map_subset(customer: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    return _id_map(customer, supplier, part).where(F.col("table_name").isin("part", "supplier"))


@QUERIES.of("orders", sql="SELECT count(DISTINCT o_custkey) AS n_tables, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'P') AS n_failed, bool_and(o_totalprice > 0) AS all_positive FROM orders")
def sum_by_table(orders: DataFrame) -> DataFrame:
    """Totals of a run over its tables, from a row per table."""
    tables = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.bool_and(F.col("o_totalprice") > 0).alias("fine"))
    return tables.agg(F.count("*").alias("n_tables"), F.sum("n").alias("n_rows"), F.sum("failed").alias("n_failed"), F.bool_and("fine").alias("all_positive"))


@QUERIES.of("orders", sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0")
def rollback_effect(orders: DataFrame) -> DataFrame:
    """A table after the rows of one run are taken out of it again, by the run's name on them."""
    runs = orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 6 == 0, "run-2").otherwise("run-1").alias("run"))
    return runs.where("run <> 'run-2'").drop("run")


@QUERIES.of("orders", sql="SELECT o_orderkey, o_orderstatus FROM orders")
def resume_effect(orders: DataFrame) -> DataFrame:
    """A table that a run left half copied, after the next run went on behind the last key."""
    rows = orders.select("o_orderkey", "o_orderstatus")
    half = rows.where(F.col("o_orderkey") <= rows.agg(F.floor(F.avg("o_orderkey"))).first()[0])
    last = half.agg(F.max("o_orderkey")).first()[0]
    return half.unionByName(rows.where(F.col("o_orderkey") > last))


@QUERIES.of("events", sql="SELECT event_id, event_id - first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS growth FROM events")
def growth_frame(events: DataFrame) -> DataFrame:
    """The change over the last ten samples."""
    last_ten = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return events.select("event_id", (F.col("event_id") - F.first("event_id").over(last_ten)).alias("growth"))


@QUERIES.of("orders", sql="SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END DESC NULLS LAST, o_orderkey) AS place FROM orders ORDER BY 2 LIMIT 40")
def sort_nulls(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    first = orders.select("o_orderkey", status.alias("s")).orderBy(F.desc_nulls_last("s"), "o_orderkey").limit(40)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc_nulls_last("s"), "o_orderkey")).alias("place"))


@QUERIES.of("orders", sql="SELECT o_orderstatus, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1")
def view_refresh(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


@QUERIES.of("lineitem", sql="SELECT l_returnflag, round(sum(CAST(l_discount AS DECIMAL(9,2)) * CAST(l_quantity AS DECIMAL(9,0))) / sum(CAST(l_quantity AS DECIMAL(9,0))), 6) AS rate FROM lineitem GROUP BY 1")
def weighted_rate(lineitem: DataFrame) -> DataFrame:
    rate, weight = F.col("l_discount").cast("decimal(9,2)"), F.col("l_quantity").cast("decimal(9,0)")
    return lineitem.groupBy("l_returnflag").agg(F.round((F.sum(rate * weight) / F.sum(weight)).cast("double"), 6).alias("rate"))


@QUERIES.of("part", sql="SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def enum_values(part: DataFrame) -> DataFrame:
    return part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@QUERIES.of("orders", sql="SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def first_occurrence(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@QUERIES.of("orders", sql="SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running FROM orders")
def running_total(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return orders.select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).alias("running"))


@QUERIES.of("events", sql="SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS growth FROM events")
def growth_lag(events: DataFrame) -> DataFrame:
    return events.select("event_id", (F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("growth"))


@QUERIES.of("customer", sql="SELECT c_nationkey, max(c_name) FILTER (c_acctbal > 0) AS name, bool_or(c_acctbal < 0) AS in_debt, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def merge_duplicates(customer: DataFrame) -> DataFrame:
    name = F.max(F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return customer.groupBy("c_nationkey").agg(name.alias("name"), F.bool_or(F.col("c_acctbal") < 0).alias("in_debt"), F.min("c_custkey").alias("first_key"))


def ordered_labels(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """``keys`` and ``labels``: the distinct labels of each group, in order of where they first stand."""
    first = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.min(order).alias("_at"))
    # a row for each label of a group
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", label))).getField(label).alias("labels"))


def merged_rows(df: DataFrame, keys: list[str], order: str, first: tuple[str, ...] = (), any_: tuple[str, ...] = (), least: tuple[str, ...] = ()) -> DataFrame:
    """One row of all that have a key: the first value that isn't null by ``order``, whether any is true, or the least, as each column asks."""
    values = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first] + [F.bool_or(c).alias(c) for c in any_] + [F.min(c).alias(c) for c in least]
    return df.groupBy(*keys).agg(*values)


@QUERIES.of("orders", sql="SELECT o_orderstatus, string_agg(o_orderpriority, ',' ORDER BY place) AS labels FROM (SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS place FROM orders GROUP BY 1, 2) GROUP BY 1")
def enum_labels(orders: DataFrame) -> DataFrame:
    return ordered_labels(orders, ["o_orderstatus"], "o_orderpriority", "o_orderkey").withColumn("labels", F.array_join("labels", ","))


@QUERIES.of(
    "customer",
    sql="""SELECT c_nationkey, arg_min(c_name, c_custkey) FILTER (c_custkey % 3 <> 0) AS name, bool_or(c_acctbal < -900) AS in_debt, min(c_acctbal) AS c_acctbal FROM customer GROUP BY 1""",
)
def merge_first_values(customer: DataFrame) -> DataFrame:
    rows = customer.select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), (F.col("c_acctbal") < -900).alias("in_debt"), "c_acctbal")
    return merged_rows(rows, ["c_nationkey"], "c_custkey", first=("name",), any_=("in_debt",), least=("c_acctbal",))

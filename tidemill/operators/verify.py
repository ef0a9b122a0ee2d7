"""Verification of a target against its source, by count and by field."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType

from tidemill.plans.declare import Queries

QUERIES = Queries()
TOLERANCE = 1e-4
SECONDS = 1


def same(a: Column, b: Column, kind: DataType, strict: bool = False) -> Column:
    """Whether two values of a type are one: floats within ``TOLERANCE``, times within a second unless ``strict``, texts of JSON by what they say, null only as null."""
    equal = a.eqNullSafe(b)
    if isinstance(kind, (DoubleType, FloatType)):
        return equal | F.coalesce(F.abs(a - b) < TOLERANCE, F.lit(False))
    if isinstance(kind, (TimestampType, TimestampNTZType)) and not strict:
        apart = F.abs(F.timestamp_diff("MICROSECOND", a, b))
        return equal | F.coalesce(apart <= SECONDS * 1_000_000, F.lit(False))
    if isinstance(kind, StringType):
        looks = lambda c: F.substring(F.ltrim(c), 1, 1).isin("{", "[")
        plain = lambda c: F.to_json(F.try_parse_json(c))
        return equal | F.coalesce(looks(a) & looks(b) & (plain(a) == plain(b)), F.lit(False))
    return equal


def compare(source: DataFrame, target: DataFrame, key: str | list[str], columns: str | Iterable[str], strict: bool = False) -> DataFrame:
    """The key columns, ``state`` (missing, extra, different, equal) and ``fields``, the columns that differ.

    Every row of either side is compared; keys are matched null-safe, so a
    null key is a row like any other. Rows that repeat a key are compared by
    occurrence, in order of their columns: two with two, and a third is
    missing or extra.
    """
    keys, columns = [key] if isinstance(key, str) else list(key), [columns] if isinstance(columns, str) else list(columns)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*(columns or [F.lit(1)])))
    s = source.select(*keys, *columns, nth.alias("_n")).select(*keys, "_n", *(F.col(c).alias(f"_s_{c}") for c in columns), F.lit(1).alias("_in_s"))
    t = target.select(*keys, *columns, nth.alias("_n")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_n").alias("_nth"), *(F.col(c).alias(f"_t_{c}") for c in columns), F.lit(1).alias("_in_t"))
    met = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_n") == F.col("_nth"))
    unlike = F.array_compact(F.array(*(F.when(~same(F.col(f"_s_{c}"), F.col(f"_t_{c}"), source.schema[c].dataType, strict), F.lit(c)) for c in columns)))
    here = F.col("_in_s").isNotNull() & F.col("_in_t").isNotNull()
    state = F.when(F.col("_in_t").isNull(), "missing").when(F.col("_in_s").isNull(), "extra").when(F.size(unlike) == 0, "equal").otherwise("different")
    return s.join(t, met, "full").select(*(F.coalesce(k, f"_k_{k}").alias(k) for k in keys), state.alias("state"), F.when(here, unlike).alias("fields"))


def count_rows(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``table_name, n_source, n_target, difference, matches``, a row per pair of tables; counts are exact."""
    counted = lambda df, n: df.agg(F.count("*").alias(n))
    rows = [counted(s, "n_source").crossJoin(counted(t, "n_target")).select(F.lit(name).alias("table_name"), "n_source", "n_target") for name, (s, t) in pairs.items()]  # a row each
    return reduce(DataFrame.unionByName, rows).withColumns({"difference": F.col("n_target") - F.col("n_source"), "matches": F.col("n_source") == F.col("n_target")})


def summary(compared: DataFrame) -> DataFrame:
    """One row: how many rows are in each state, the verdict, and what to do about it."""
    counts = [F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("equal", "different", "missing", "extra")]
    total = compared.agg(*counts, F.bool_and(F.col("state") == "equal").alias("_all"))
    advice = F.when(F.col("n_missing") > 0, "copy the missing rows again").when(F.col("n_different") > 0, "look at the fields that differ").when(F.col("n_extra") > 0, "remove rows that the source lacks").otherwise("nothing")
    return total.select("n_equal", "n_different", "n_missing", "n_extra", F.coalesce("_all", F.lit(True)).alias("matches"), advice.alias("advice"))


def verified(source: DataFrame, target: DataFrame, key: str, columns: list[str], skip: Iterable[str] = (), sample: int | None = None) -> DataFrame:
    """``compare`` without the columns in ``skip``, of all rows or of the first ``sample`` by key (missing and different ones alone then)."""
    columns = [c for c in columns if c not in set(skip)]
    if sample is not None:
        source = source.orderBy(key).limit(sample)
        target = target.join(source.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return compare(source, target, key, columns)


@QUERIES.of("orders", sql="SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'different' ELSE 'equal' END AS state, count(*) AS n FROM orders GROUP BY 1")
def verify_fields(orders: DataFrame) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 0.00001)
    target = orders.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", price)
    return compare(orders, target, "o_orderkey", "o_totalprice").groupBy("state").agg(F.count("*").alias("n"))


@QUERIES.of("orders", sql="SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'o_orderstatus' WHEN 2 THEN 'o_orderdate' WHEN 4 THEN 'note' ELSE '' END AS fields FROM orders")
def verify_types(orders: DataFrame) -> DataFrame:
    """Texts, times (half a second and two seconds off), JSON with spaces, and null against text."""
    source = orders.selectExpr("o_orderkey", "o_orderstatus", "o_orderdate", """concat('{"a": 1, "b": [', o_orderkey, ']}') AS note""")
    case = "CASE o_orderkey % 5 WHEN"
    target = source.selectExpr(
        "o_orderkey", f"{case} 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        f"{case} 2 THEN o_orderdate + interval 2 seconds WHEN 3 THEN o_orderdate + interval 500 milliseconds ELSE o_orderdate END AS o_orderdate",
        f"""{case} 3 THEN concat('{{"a":1,"b":[', o_orderkey, ']}}') WHEN 4 THEN '{{"a": 2}}' ELSE note END AS note""",
    )
    return compare(source, target, "o_orderkey", ["o_orderstatus", "o_orderdate", "note"]).select("o_orderkey", F.array_join("fields", ",").alias("fields"))


@QUERIES.of("orders", "customer", sql="""SELECT 'orders' AS table_name, count(*) AS n_source, count(*) FILTER (o_orderkey % 11 <> 0) AS n_target, -count(*) FILTER (o_orderkey % 11 = 0) AS difference, false AS matches FROM orders
    UNION ALL SELECT 'customer', count(*), count(*), 0, true FROM customer""")  # fmt: skip
def verify_counts(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return count_rows({"orders": (orders, orders.where("o_orderkey % 11 <> 0")), "customer": (customer, customer)})


@QUERIES.of("orders", sql="SELECT o_orderkey, 'missing' AS state FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT -o_orderkey - 1, 'extra' FROM orders WHERE o_orderkey % 13 = 0")
def verify_missing_extra(orders: DataFrame) -> DataFrame:
    target = orders.where("o_orderkey % 11 <> 0").select("o_orderkey").union(orders.where("o_orderkey % 13 = 0").select(-F.col("o_orderkey") - 1))
    return compare(orders, target, "o_orderkey", []).where("state <> 'equal'").select("o_orderkey", "state")


@QUERIES.of("customer", sql="SELECT count(*) FILTER (c_custkey % 4 > 1) AS n_equal, count(*) FILTER (c_custkey % 4 = 1) AS n_different, count(*) FILTER (c_custkey % 4 = 0) AS n_missing, 0 AS n_extra, false AS matches, 'copy the missing rows again' AS advice FROM customer")
def verify_summary(customer: DataFrame) -> DataFrame:
    target = customer.where("c_custkey % 4 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 4 == 1, "?").otherwise(F.col("c_name")))
    return summary(compare(customer, target, "c_custkey", ["c_name", "c_acctbal"]))


@QUERIES.of("customer", sql="SELECT c_custkey, 'different' AS state FROM customer WHERE c_custkey % 3 = 0 AND c_custkey IN (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 10)")
def verify_sample(customer: DataFrame) -> DataFrame:
    target = customer.withColumns({"c_acctbal": F.when(F.col("c_custkey") % 3 == 0, 0.5).otherwise(F.col("c_acctbal")), "c_name": F.lit("skipped")})
    return verified(customer, target, "c_custkey", ["c_name", "c_acctbal"], skip=["c_name"], sample=10).where("state <> 'equal'").select("c_custkey", "state")

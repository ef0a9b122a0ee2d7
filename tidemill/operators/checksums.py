"""Verification of large tables by checksums of key ranges: only ranges that differ are compared by field.

Both tables are read once for a row per range: how many rows, and two
checksums that don't depend on their order. Ranges that differ are cut into
smaller ones and looked at again, so that a few wrong rows of a large table
come down to a few small ranges. Their rows, and no others, are joined.

Ranges are cut at keys of a bounded sample of the source; that decides how
much is joined, not what is found. Rows that ``compare`` takes for equal though
they aren't the same to the bit (floats within its tolerance, times within a
second) make their range differ, and are then compared like any other. Rows
without a key are a range of their own, and repeated keys are compared by
occurrence, as ``compare`` does.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.verify import compare
from tidemill.plans.declare import Queries, written

QUERIES = Queries()
#: Rows that ranges are cut by, ranges of the first round, parts of a range that differs, and rounds.
SAMPLE = 10_000
RANGES = 128
PARTS = 16
ROUNDS = 3
#: Ranges of a later round at most: more rows are joined where there would be more.
MOST_RANGES = 256

#: From (in, None: no bound) and to (out).
Range = tuple[Any, Any]


def inside(key: str, range_: Range) -> Column:
    """Whether a key lies in a range; conditions of this form reach the scan."""
    low, high = range_
    return (F.lit(True) if low is None else F.col(key) >= F.lit(low)) & (F.lit(True) if high is None else F.col(key) < F.lit(high))


def in_any(key: str, ranges: list[Range]) -> Column:
    """Whether a key lies in one of several ranges, as a tree of conditions that is no deeper than it must be."""
    if len(ranges) < 2:
        return inside(key, ranges[0]) if ranges else F.lit(False)
    return in_any(key, ranges[: len(ranges) // 2]) | in_any(key, ranges[len(ranges) // 2 :])


def merged(ranges: list[Range]) -> list[Range]:
    """Ordered ranges, with those that touch as one."""
    out: list[Range] = []
    for low, high in ranges:
        if out and out[-1][1] == low and low is not None:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def number_of(key: str, cuts: list) -> Column:
    """How many of the ordered cuts a key has reached, by halving."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(F.col(key) < F.lit(cuts[middle]), number_of(key, cuts[:middle])).otherwise(F.lit(middle + 1) + number_of(key, cuts[middle + 1 :]))


def cuts_of(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` keys that cut the rows into parts of about a size, from those with the smallest hashes."""
    sample = sorted({r[0] for r in df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key)).limit(SAMPLE).collect()})
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)} - set(sample[:1])) if sample else []


def checksums(df: DataFrame, key: str, columns: list[str], cuts: list) -> DataFrame:
    """``range, n, one, two`` for each range of keys; rows without a key are range -1."""
    hashes = [F.xxhash64(F.lit(i), key, *columns) for i in (1, 2)]
    number = F.when(F.col(key).isNull(), -1).otherwise(number_of(key, cuts)).alias("range")
    # a sum tells copies apart, which cancel out by pairs in an exclusive or
    return df.select(number, hashes[0].alias("_a"), hashes[1].alias("_b")).groupBy("range").agg(F.count("*").alias("n"), F.bit_xor("_a").alias("one"), F.sum(F.col("_b").cast("decimal(38,0)")).alias("two"))


def unlike_ranges(source: DataFrame, target: DataFrame, key: str, columns: list[str], cuts: list) -> set[int]:
    """The numbers of the ranges that differ; a row for each range on either side."""
    s, t = (checksums(df, key, columns, cuts) for df in (source, target))
    named = t.select(*(F.col(c).alias(f"_{c}") for c in t.columns))
    met = F.col("range") == F.col("_range")
    same = F.coalesce(met & (F.col("n") == F.col("_n")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), F.lit(False))
    return {r[0] for r in s.join(named, met, "full").where(~same).select(F.coalesce("range", "_range")).collect()}


def differing(source: DataFrame, target: DataFrame, key: str, columns: list[str], rounds: int = ROUNDS) -> tuple[list[Range], bool]:
    """The ranges of keys in which the tables differ, and whether rows without a key do."""
    cuts = cuts_of(source, key, RANGES)
    nulls, found = False, [(None, None)]
    for round_ in range(rounds):
        numbers = unlike_ranges(source.where(in_any(key, found) | F.col(key).isNull()), target.where(in_any(key, found) | F.col(key).isNull()), key, columns, cuts)
        nulls = -1 in numbers
        ends = [None, *cuts, None]
        found = merged([(ends[n], ends[n + 1]) for n in sorted(numbers) if n >= 0])
        if not found or len(numbers) > MOST_RANGES // 4 or round_ == rounds - 1:
            break  # nothing differs, or so much that smaller ranges would not spare much
        inner = cuts_of(source.where(in_any(key, found)), key, min(PARTS * len(numbers), MOST_RANGES))
        # the ends of what differs stay ends, so a finer range never reaches into an equal one
        cuts = sorted({*inner, *(e for r in found for e in r if e is not None)})
    return found, nulls


def verify_ranges(source: DataFrame, target: DataFrame, key: str, columns: list[str], strict: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """The states of ``compare`` for every row, with a join of the rows in ranges that differ alone."""
    columns = list(columns)
    ranges, nulls = differing(source, target, key, columns, rounds)
    # a plain condition, so that it reaches the scans
    apart = in_any(key, ranges) | F.col(key).isNull() if nulls else in_any(key, ranges)
    joined = compare(source.where(apart), target.where(apart), key, columns, strict)
    equal = source.where(~F.coalesce(apart, F.lit(False))).select(key, F.lit("equal").alias("state"), F.array().cast("array<string>").alias("fields"))
    return joined.unionByName(equal)


_KEY = "(l_orderkey * 8 + l_linenumber)"
_WRONG = f"{_KEY} > (SELECT max({_KEY}) FROM lineitem) * 0.9 AND {_KEY} % 50 = 3"
_GONE = f"{_KEY} < 4000 AND {_KEY} % 50 = 1"


@QUERIES.of("lineitem", sql=f"SELECT {_KEY} AS id, CASE WHEN {_GONE} THEN 'missing' ELSE 'different' END AS state, CASE WHEN {_GONE} THEN NULL ELSE 'l_quantity' END AS fields FROM lineitem WHERE ({_WRONG}) OR ({_GONE})")
def verify_checksums(lineitem: DataFrame) -> DataFrame:
    """What is wrong with a copy of ``lineitem`` that lacks rows at its start and has wrong ones at its end."""
    source = lineitem.selectExpr(f"{_KEY} AS id", "l_quantity", "l_extendedprice", "l_shipdate")
    top = source.agg((F.max("id") * 0.9).alias("_top"))
    wrong = (F.col("id") > F.col("_top")) & (F.col("id") % 50 == 3)
    target = source.crossJoin(F.broadcast(top)).withColumn("l_quantity", F.col("l_quantity") + F.when(wrong, 1).otherwise(0)).drop("_top")  # a single row
    target = written(target.where("NOT (id < 4000 AND id % 50 = 1)"), "verified")
    found = verify_ranges(source, target, "id", ["l_quantity", "l_extendedprice", "l_shipdate"]).where("state <> 'equal'")
    return found.select("id", "state", F.array_join("fields", ",").alias("fields"))


@QUERIES.of("lineitem", sql=f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN {_KEY} % 1000 = 7 THEN 'missing' ELSE 'equal' END AS state FROM lineitem UNION ALL SELECT 'extra' FROM lineitem WHERE {_KEY} % 500 = 9) GROUP BY 1")
def verify_checksum_states(lineitem: DataFrame) -> DataFrame:
    """How many rows are in each state; every range has some that differ, and prices differ by less than the tolerance."""
    source = lineitem.selectExpr(f"{_KEY} AS id", "l_extendedprice")
    target = source.where("id % 1000 <> 7").withColumn("l_extendedprice", F.col("l_extendedprice") + F.when(F.col("id") % 3 == 0, 1e-6).otherwise(0.0))
    target = target.unionByName(source.where("id % 500 = 9").withColumn("id", -F.col("id") - 1))
    return verify_ranges(source, written(target, "verified"), "id", ["l_extendedprice"]).groupBy("state").agg(F.count("*").alias("n"))

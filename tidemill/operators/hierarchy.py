"""Rows that refer to other rows: all ancestors of each, and rings, by doubling; cycles do no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries, written

QUERIES = Queries()
#: Rows of a part of a round, about 40 bytes each.
PART_ROWS = 500_000


def _parts(rows: int) -> int:
    return 1 + rows // PART_ROWS


def ancestors(links: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, ancestor, depth``: every row above each row, at the least number of steps.

    A round prolongs the longest paths that are known, by all that are known, so
    paths double in length and each comes up once: a chain of a thousand takes
    ten rounds. Each round is written in parts of about ``PART_ROWS`` rows, so
    that a task holds no more of a larger table. The last round is the one that
    finds no path of full length. A row may have several parents. On a cycle a
    row is its own ancestor, at the length of the shortest way round. Null
    nodes and parents refer to nothing.
    """
    steps = links.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).dropna().distinct()
    found, length = written(steps.withColumn("depth", F.lit(1).cast("long")), "ancestors"), 1
    while longest := found.where(F.col("depth") == length).count():
        n = found.count()
        # the first half of a shortest path of more steps is itself a shortest path
        ends = found.where(F.col("depth") == length).select("node", F.col("ancestor").alias("_via"))
        above = found.select(F.col("node").alias("_via"), "ancestor", (F.col("depth") + length).alias("depth"))
        further = ends.repartition(_parts(n), "_via").join(above.repartition(_parts(n), "_via"), "_via").select("node", "ancestor", "depth")
        every = found.unionByName(further).repartition(_parts(n + length * longest), "node", "ancestor")
        found, length = written(every.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "ancestors"), 2 * length
    return found


def rings(found: DataFrame) -> DataFrame:
    """``node, ring``: the rows of ``ancestors`` that are on a cycle, with its smallest member."""
    on = found.where("node = ancestor").select("node")
    above = found.join(on, "node").join(on.select(F.col("node").alias("ancestor")), "ancestor").select("node", "ancestor")
    back = above.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    return above.join(back, ["node", "ancestor"]).groupBy("node").agg(F.min("ancestor").alias("ring"))


def rings_of(links: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, ring`` as from ``rings``, without all ancestors where no row has several parents.

    Then a jump leads from each row to one above it, and jumps double in length.
    Only rows that a jump leads to are gone on with; once those are as many as
    before, all of them are on cycles. The smallest member comes by doubling too.
    """
    steps = written(links.select(F.col(node).alias("node"), F.col(parent).alias("above")).dropna().distinct(), "steps")
    if not steps.groupBy("node").count().where("count > 1").isEmpty():
        return rings(ancestors(steps, "node", "above"))
    jumps, n = steps, -1
    while True:
        alive = written(jumps.select(F.col("above").alias("node")).distinct(), "alive")
        if (left := alive.count()) == n:
            break
        n = left
        jumps = jumps.join(alive, "node")
        jumps = written(jumps.join(jumps.select(F.col("node").alias("above"), F.col("above").alias("_next")), "above").select("node", F.col("_next").alias("above")), "jumps")
    on = steps.join(alive, "node")
    lows = written(on.select("node", "above", F.least("node", "above").alias("ring")), "rings")
    while True:
        ahead = lows.select(F.col("node").alias("above"), F.col("above").alias("_next"), F.col("ring").alias("_ring"))
        further = lows.join(ahead, "above").select("node", F.col("_next").alias("above"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("_lower"))
        further = written(further, "rings")
        lows = further.drop("_lower")
        if further.where("_lower").isEmpty():
            return lows.select("node", "ring")


_MANAGERS = "SELECT c.c_custkey AS node, m.c_custkey AS ancestor FROM customer c JOIN customer m ON m.c_custkey = c.c_custkey // 2 AND m.c_custkey <> c.c_custkey"
_SQUARES = "SELECT c.c_custkey AS node, m.c_custkey AS ancestor FROM customer c JOIN customer m ON m.c_custkey = (c.c_custkey * c.c_custkey + 1) % (SELECT count(*) FROM customer)"


def _managers(customer: DataFrame, manager) -> DataFrame:
    rows = customer.select(F.col("c_custkey").alias("node"), manager.cast("long").alias("parent"))
    return rows.join(customer.select(F.col("c_custkey").alias("parent")), "parent").select("node", "parent")


@QUERIES.of("customer", sql=f"WITH RECURSIVE l AS ({_MANAGERS}), r(node, ancestor, depth) AS (SELECT node, ancestor, 1 FROM l UNION ALL SELECT r.node, l.ancestor, r.depth + 1 FROM r JOIN l ON l.node = r.ancestor) SELECT * FROM r")
def hierarchy_ancestors(customer: DataFrame) -> DataFrame:
    """All managers of each customer, with how far they are above."""
    links = _managers(customer, F.floor(F.col("c_custkey") / 2)).where("node <> parent")
    return ancestors(links, "node", "parent")


@QUERIES.of("customer", sql=f"WITH RECURSIVE l AS ({_SQUARES}), r(node, ancestor) AS (SELECT node, ancestor FROM l UNION SELECT r.node, l.ancestor FROM r JOIN l ON l.node = r.ancestor), o AS (SELECT node FROM r WHERE node = ancestor) SELECT r.node, min(r.ancestor) AS ring FROM r JOIN o ON o.node = r.node JOIN o b ON b.node = r.ancestor GROUP BY 1")
def hierarchy_rings(customer: DataFrame) -> DataFrame:
    """Customers that are above themselves, where links lead round in circles."""
    n = F.broadcast(customer.agg(F.count("*").alias("_n")))
    square = (F.col("c_custkey") * F.col("c_custkey") + 1) % F.col("_n")
    return rings_of(_managers(customer.crossJoin(n), square), "node", "parent")  # a single row

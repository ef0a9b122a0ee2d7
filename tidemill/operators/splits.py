"""Splits of an ordered table into chunks of bounded size, filled greedily, in parallel within a group too.

Where a chunk starts depends on where the one before it did, so a group looks
as if one task had to go through it. But what a stretch of rows does depends
only on which of its first rows starts a chunk, and a chunk that comes from
before ends within the first ``most`` bytes. So rows are dealt into ranges by
group and order, and

1. each range says, for every row near its head that may start a chunk, how
   many chunks follow and how full the last is at the end of the range;
2. how full a chunk is tells which row of the next range starts one, which
   makes links between such rows;
3. the links are followed from where each group begins by doubling: the rows
   that do start a chunk are found in as many rounds as the number of ranges
   has digits in base two;
4. each range numbers its rows from there.

Steps 2 and 3 work on the heads of ranges alone, and rounds are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.summaries import dealt_in_order
from tidemill.plans.declare import Queries, written

QUERIES = Queries()
#: Rows of a range, which a task holds whole.
RANGE_ROWS = 250_000
_NODE = "range int, entry long, n long, fill long, low long, high long"


def starts(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, which starts the next chunk if it starts one, and the bytes before and through it."""
    through = np.cumsum(sizes)
    before = through - sizes
    # a chunk takes a row that would overfill it only while it is empty
    return np.maximum(np.searchsorted(through, before + most, "right"), np.searchsorted(before, before, "right")), before, through


def _summary(table: pa.Table, most: int) -> pa.Table:
    """The nodes of a range: rows of its first group that may start a chunk, and entry -1 for a last group that begins here."""
    number, group = table.column("_range")[0].as_py(), table.column("_g").to_numpy()
    sizes = table.column("_size").to_numpy()
    head = int(np.searchsorted(group, group[0], "right"))
    following, before, through = starts(sizes[:head], most)
    whole = head == len(group)
    near = min(head, int(np.searchsorted(before, most, "right")) + 1)
    n, last = np.ones(head, np.int64), np.arange(head)
    for i in range(head - 1, -1, -1):
        if following[i] < head:
            n[i], last[i] = n[following[i]] + 1, last[following[i]]
    fill = [int(through[-1] - before[x]) if whole else None for x in last[:near]]
    rows = [(number, e, int(n[e]), fill[e], int(before[e]), int(through[e])) for e in range(near)]
    if not whole:
        tail = sizes[int(np.searchsorted(group, group[-1])) :]
        following, before, through = starts(tail, most)
        at = count = 0
        while at < len(tail):
            last_start, count, at = at, count + 1, following[at]
        rows.append((number, -1, count, int(through[-1] - before[last_start]), None, None))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)], names=["range", "entry", "n", "fill", "low", "high"])


def _looked_up(asked: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """``asked`` (``source, range, fill``) with ``entry``, the first row of the range's head that starts a chunk, or null."""
    offered = heads.select("range", F.col("high").alias("_v"), F.lit(0).alias("_kind"), "entry", "low", *(F.lit(None).cast("long").alias(c) for c in ("source", "fill")))
    wanted = asked.select("range", (most - F.col("fill")).alias("_v"), F.lit(1).alias("_kind"), *(F.lit(None).cast("long").alias(c) for c in ("entry", "low")), "source", "fill")
    # from large to small, the last row passed is the first that overfills; an empty chunk takes any first row
    order = Window.partitionBy("range").orderBy(F.desc("_v"), F.desc("_kind"), F.desc("entry"))
    passed = lambda c: F.last(c, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = offered.unionByName(wanted).withColumn("_full", passed("entry")).withColumn("_empty", passed(F.when(F.col("low") > 0, F.col("entry")))).where("_kind = 1")
    return found.select("source", "range", "fill", F.when(F.col("fill") > 0, F.col("_full")).otherwise(F.col("_empty")).alias("entry"))


def _number(range_, entry):
    return F.col(range_).cast("long") * (1 << 40) + F.col(entry) + 1


def entries(nodes: DataFrame, ranges: DataFrame, most: int) -> DataFrame:
    """``range, entry, chunk``: the first row of each continued range that starts a chunk, past its head if none does, and that chunk's number."""
    nodes = written(nodes.withColumn("node", _number("range", "entry")), "split-nodes")
    heads = nodes.where("entry >= 0")
    # an unbroken range that begins its group is entered at its first row
    begun = ranges.where("NOT continued").select("range")
    links, passed = [], []
    asked = nodes.where("fill IS NOT NULL").select(F.col("node").alias("source"), (F.col("range") + 1).alias("range"), "fill")
    asked = written(asked.join(ranges.where("continued").select("range"), "range"), "split-asked")
    while not asked.isEmpty():
        found = written(_looked_up(asked, heads, most), "split-found")
        links.append(found.where("entry IS NOT NULL").select("source", _number("range", "entry").alias("target")))
        through = found.where("entry IS NULL").join(ranges.select("range", "head_bytes", "n_head", "whole"), "range")
        through = written(through, "split-through")
        passed.append(through.select("source", "range", F.col("n_head").alias("entry")))
        asked = through.where("whole").select("source", (F.col("range") + 1).alias("range"), (F.col("fill") + F.col("head_bytes")).alias("fill"))
        asked = written(asked.join(ranges.where("continued").select("range"), "range"), "split-asked")
    none = nodes.sparkSession.createDataFrame([], "source long, target long")
    steps = none
    for some in links:
        steps = steps.unionByName(some)
    weights = nodes.select(F.col("node").alias("source"), "n")
    steps = written(steps.join(weights, "source"), "split-steps")
    # the beginnings: groups that start within a range, and ranges that start a group
    reached = nodes.where("entry = -1").select("node", F.lit(0).cast("long").alias("chunk"))
    reached = reached.unionByName(heads.where("entry = 0").join(begun, "range").select("node", F.lit(0).cast("long").alias("chunk")))
    reached, n = written(reached.distinct(), "split-reached"), -1
    while (grown := reached.count()) != n:
        n = grown
        ahead = reached.join(steps, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("chunk") + F.col("n")).alias("chunk"))
        reached = written(reached.unionByName(ahead).distinct(), "split-reached")
        further = steps.select(F.col("source").alias("target"), F.col("target").alias("_t"), F.col("n").alias("_n"))
        steps = written(steps.join(further, "target").select("source", F.col("_t").alias("target"), (F.col("n") + F.col("_n")).alias("n")).unionByName(steps), "split-steps")
    here = nodes.where("entry >= 0").join(reached, "node").join(ranges.where("continued").select("range"), "range").select("range", "entry", "chunk")
    for some in passed:
        on = some.join(reached, F.col("source") == F.col("node")).join(weights, "source")
        here = here.unionByName(on.select("range", "entry", (F.col("chunk") + F.col("n")).alias("chunk")))
    return here


def byte_chunks(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """The rows with ``chunk``: within a group, in order, a chunk is filled until the next row would make it larger than ``most``; a larger row is alone.

    Rows of one place in the order go by a hash of their other columns; null
    groups are a group, null sizes are 0.
    """
    # groups by number within a range, so that any type of group will do
    dealt = dealt_in_order(df, group, order, rows=RANGE_ROWS)
    by_group = Window.partitionBy("_range").orderBy(group)
    in_order = lambda t: t.sort_by([("_g", "ascending"), ("_place", "ascending")])
    place = F.row_number().over(Window.partitionBy("_range").orderBy(group, order, "_tie")).cast("long")
    slim = dealt.select("_range", F.dense_rank().over(by_group).cast("long").alias("_g"), place.alias("_place"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    nodes = slim.groupBy("_range").applyInArrow(lambda t: _summary(in_order(t), most), _NODE)
    ends = dealt.groupBy("_range").agg(F.min(F.struct(F.col(group).alias("g"))).alias("_first"), F.max(F.struct(F.col(group).alias("g"))).alias("_last"))
    heads = slim.where("_g = 1").groupBy("_range").agg(F.sum("_size").alias("head_bytes"), F.count("*").alias("n_head"))
    before = F.lag("_last").over(Window.orderBy("_range"))  # a row for each range
    numbered = F.row_number().over(Window.orderBy("_range")).cast("int") - 1
    ranges = ends.join(heads, "_range").select("_range", numbered.alias("range"), "head_bytes", "n_head", F.col("_first").eqNullSafe(F.col("_last")).alias("whole"), F.coalesce(before.eqNullSafe(F.col("_first")), F.lit(False)).alias("continued"))
    ranges = written(ranges, "split-ranges")
    placed = nodes.withColumnRenamed("range", "_range").join(F.broadcast(ranges.select("_range", "range")), "_range").drop("_range")
    found = written(entries(placed, ranges, most), "split-entries")
    found = ranges.join(found, "range", "left").select("_range", "continued", "entry", F.col("chunk").alias("_chunk"))
    names = df.columns

    def number(table: pa.Table) -> pa.Table:
        table = in_order(table)
        group_, sizes = table.column("_g").to_numpy(), table.column("_size").to_numpy()
        out = np.zeros(len(sizes), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group_)) + 1, [len(group_)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = chunk = 0
            if lo == 0 and table.column("continued")[0].as_py():
                at, chunk = table.column("entry")[0].as_py(), table.column("_chunk")[0].as_py()
                out[: min(at, hi)] = chunk - 1
            following, *_ = starts(sizes[lo:hi], most)
            while at < hi - lo:
                out[lo + at : lo + following[at]] = chunk
                at, chunk = int(following[at]), chunk + 1
        return table.select(names).append_column("chunk", pa.array(out))

    rows = dealt.withColumn("_g", F.dense_rank().over(by_group).cast("long")).withColumn("_place", place).withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    rows = rows.join(F.broadcast(found), "_range")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.groupBy("_range").applyInArrow(number, f"{schema}, chunk long")


_SPLIT = """WITH RECURSIVE o AS (SELECT {group} AS g, o_orderkey, 40 + o_orderkey % 90 AS n, row_number() OVER (PARTITION BY {group} ORDER BY o_orderkey) AS k FROM orders),
    f AS (SELECT g, o_orderkey, k, n AS filled, CAST(0 AS BIGINT) AS chunk FROM o WHERE k = 1
    UNION ALL SELECT o.g, o.o_orderkey, o.k, CASE WHEN f.filled + o.n > {most} THEN o.n ELSE f.filled + o.n END, f.chunk + CASE WHEN f.filled + o.n > {most} THEN 1 ELSE 0 END
    FROM f JOIN o ON o.g = f.g AND o.k = f.k + 1) SELECT o_orderkey, chunk FROM f"""


@QUERIES.of("orders", sql=_SPLIT.format(group="o_custkey", most=200))
def batch_split_bytes(orders: DataFrame) -> DataFrame:
    rows = orders.selectExpr("o_custkey", "o_orderkey", "40 + o_orderkey % 90 AS n_bytes")
    return byte_chunks(rows, "o_custkey", "o_orderkey", "n_bytes", 200).select("o_orderkey", "chunk")


@QUERIES.of("orders", sql=_SPLIT.format(group="o_orderstatus", most=1000))
def batch_split_large_groups(orders: DataFrame) -> DataFrame:
    """Three groups of which two hold nearly all rows: their chunks go over many tasks."""
    rows = orders.selectExpr("o_orderstatus", "o_orderkey", "40 + o_orderkey % 90 AS n_bytes").repartition(8)
    return byte_chunks(rows, "o_orderstatus", "o_orderkey", "n_bytes", 1000).select("o_orderkey", "chunk")

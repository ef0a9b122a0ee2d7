"""Links between vectors of a cosine at a threshold, by a pigeonhole join over subspaces; exact.

For unit vectors a cosine of ``t`` is a squared distance of ``2 - 2 t``. Vectors
are rotated, which spreads what they differ in, and split into blocks of
``BLOCK`` coordinates. Two vectors within the distance are, in one block at
least, within the block's share of it. So each block is range-joined for
itself, the candidates of all blocks are verified, and a pair that several
blocks find counts in the first of them.

The range join: a block's coordinates are cut at quantiles into cells. A vector
lives in one cell and visits those of lower number that lie within the block's
distance of it. Cells are compared in chunks of ``CHUNK`` rows at most, a pair
of chunks at a time, by one product of matrices; of what it finds, only sums by
vector leave the task. No row is made for a pair.

Copies are compared once, with how many there are. Large groups of near copies
would still meet within themselves: vectors within half the angle of a leader
are all linked with each other, so such a core counts by its size and its
chunks are not compared. Leaders and quantiles are fitted to ``SAMPLE`` rows at
most; they decide what is compared where, never what is found, and every row is
placed.

Defined results: null or zero vectors and those with null or non-finite
components link with nothing and are their own component; vectors of different
lengths don't link; equal rows, of one id or of several, are vectors each; a
null ``vec_id`` is passed over where the smallest is taken, and is not kept; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemill.llm.common import join_counted, numbered, release, small_enough, staged
from tidemill.llm.components import connected_components

THRESHOLD = 0.95
BLOCK = 16
#: Vectors of a block's cell that its quantiles aim at, and rows that are compared with as many at once.
CELL_ROWS = 8192
CHUNK = 16_384
#: Rows that the index is fitted to, and what a core holds at least (of all rows, and of those).
SAMPLE = 4096
CORE_ROWS = 512
CORE_SAMPLE = 16
#: Distances are rounded by less than this.
SLACK = 1e-9
COARSE = 1e-5

_CELL = ["dims", "block", "cell"]


def usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """``_row, vec_id, raw``, the bytes of each vector's components, null if it links with nothing; and their type."""
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "f8"
    own = F.col("embedding") if kind == "f4" else F.col("embedding").cast("array<double>")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            raw: list[bytes | None] = [None] * len(sizes)
            for d in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == d)
                values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
                for i, v in zip(at[good].tolist(), values[good] + 0.0, strict=True):  # no negative zero
                    raw[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("vec_id"), pa.array(raw, pa.binary())], ["_row", "vec_id", "raw"])

    rows = numbered(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("embedding")), "_row")
    return rows.mapInArrow(check, "_row long, vec_id long, raw binary"), kind


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision of bytes of one length."""
    out = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


@lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    """A fixed rotation."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def rotated(unit: np.ndarray) -> np.ndarray:
    # not a matrix product, whose last bits depend on how many rows there are
    return np.einsum("ij,jk->ik", unit, rotation(unit.shape[1]))


def blocks(dims: int) -> list[slice]:
    n = max(1, dims // BLOCK)
    ends = [dims * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


class Index:
    """Where vectors of one length are compared: quantiles of each block's coordinates, and leaders of cores."""

    def __init__(self, unit: np.ndarray, n: int, threshold: float, first_core: int = 0):
        self.dims, self.first_core = unit.shape[1], first_core
        self.budget = [max(0.0, 2 - 2 * threshold) * (b.stop - b.start) / self.dims + SLACK for b in blocks(self.dims)]
        placed = rotated(unit)
        splits = max(0, math.ceil(math.log2(max(1, n / CELL_ROWS))))
        self.cuts = []
        for b in blocks(self.dims):
            width = b.stop - b.start
            each = [min((splits + width - 1 - j) // width, 60 // width) for j in range(width)]
            self.cuts.append([np.quantile(placed[:, b.start + j], np.arange(1, 2**s) / 2**s) if s else np.zeros(0) for j, s in enumerate(each)])
        # all within half the angle of a leader are within the angle of each other
        self.close = math.cos(math.acos(min(1.0, threshold)) / 2) + SLACK
        near = unit @ unit.T >= self.close
        least, self.leaders = max(CORE_SAMPLE, SAMPLE * CORE_ROWS // max(1, n)), []
        while len(unit) and (counts := near.sum(axis=1)).max() >= least:
            self.leaders.append(unit[best := counts.argmax()])
            near[:, near[best]] = False
        self.leaders = np.array(self.leaders).reshape(-1, self.dims)

    def cores(self, unit: np.ndarray) -> np.ndarray:
        """The core of each vector, or -1."""
        if not len(self.leaders):
            return np.full(len(unit), -1)
        found = unit @ self.leaders.T
        return np.where(found.max(axis=1) >= self.close, found.argmax(axis=1) + self.first_core, -1)

    def cells(self, placed: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, cells): first where each row lives, then the cells of lower number that it visits."""
        x, budget = placed[:, blocks(self.dims)[block]], self.budget[block]
        home = np.zeros(len(x), np.int64)
        for j, cuts in enumerate(self.cuts[block]):
            home = home * (len(cuts) + 1) + np.searchsorted(cuts, x[:, j], "right")
        yield np.arange(len(x)), home
        for lo in range(0, len(x), 256):
            rows = np.arange(lo, min(lo + 256, len(x)))
            cell, cost = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for j, cuts in enumerate(self.cuts[block]):
                if not len(cuts):
                    continue
                edges = np.concatenate([[-np.inf], cuts, [np.inf]])
                at = x[rows, j][:, None]
                gap = np.maximum(0, np.maximum(edges[:-1] - at, at - edges[1:]))
                total = cost[:, None] + gap**2
                i, part = np.nonzero(total <= budget)
                rows, cell, cost = rows[i], cell[i] * (len(cuts) + 1) + part, total[i, part]
            lower = cell < home[rows]
            yield rows[lower], cell[lower]


def fit(distinct: DataFrame, kind: str, threshold: float) -> dict[int, Index]:
    """An index for each length of vectors, from the rows with the smallest hashes."""
    width = np.dtype(kind).itemsize
    sizes = {r["dims"]: r["n"] for r in distinct.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    sample: dict[int, list[bytes]] = {d: [] for d in sizes}
    for r in distinct.orderBy(F.xxhash64("raw")).limit(SAMPLE).select("raw").collect():
        sample[len(r["raw"]) // width].append(bytes(r["raw"]))
    out, first = {}, 0
    for d, raw in sorted(sample.items()):
        out[d] = Index(units(raw, kind) if raw else np.zeros((0, d)), sizes[d] if raw else 0, threshold, first)
        first += len(out[d].leaders)
    return out


def places(distinct: DataFrame, shared, kind: str) -> DataFrame:
    """``rep, copies, core, dims, block, cell, home``: where each distinct vector lives and visits."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                index, unit = shared.value[int(d)], units(part.column("raw").to_pylist(), kind)
                core, placed = pa.array(index.cores(unit), pa.int32()), rotated(unit)
                for b in range(len(index.budget)):
                    home = True
                    for rows, cells in index.cells(placed, b):
                        same = [pa.array(np.full(len(rows), x), t) for x, t in ((d, pa.int32()), (b, pa.int32()), (home, pa.bool_()))]
                        at = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([part.column("rep").take(at), part.column("copies").take(at), core.take(at), *same, pa.array(cells)], ["rep", "copies", "core", "dims", "block", "home", "cell"])
                        home = False

    return distinct.select("rep", "dims", "raw", "copies").mapInArrow(place, "rep long, copies long, core int, dims int, block int, home boolean, cell long")


def work(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of the cells, and the pairs of chunks to compare: ``pair, side`` by chunk."""
    key = [*_CELL, "home", "core"]
    sizes = staged(placed.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "cell-sizes")
    chunks = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    other = chunks.select(*_CELL, *(F.col(c).alias(f"_{c}") for c in ("home", "core", "chunk")))
    # who lives here with all who live here, each pair once, and with all visitors; not within a core
    once = ~F.col("_home") | (F.struct("core", "chunk") <= F.struct("_core", "_chunk"))
    pairs = chunks.where("home").join(other, _CELL).where(once & ((F.col("core") < 0) | (F.col("core") != F.col("_core"))))
    pairs = staged(numbered(pairs, "pair"), "chunk-pairs")
    # a chunk with itself comes once
    itself = F.col("_home") & (F.struct("core", "chunk") == F.struct("_core", "_chunk"))
    sides = pairs.select(*_CELL, "home", "core", "chunk", "pair", F.lit(0).alias("side")).unionByName(
        pairs.where(~itself).select(*_CELL, *(F.col(f"_{c}").alias(c) for c in ("home", "core", "chunk")), "pair", F.lit(1).alias("side"))
    )
    return sizes, sides


def compared(rows: DataFrame, shared, kind: str, threshold: float) -> DataFrame:
    """``rep, links, node, label``: for each vector of a pair of chunks, how many it links with there, and the least node it is joined to."""

    def candidates(a: np.ndarray, b: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        half = lambda x: -np.einsum("ij,ij->i", x, x)[:, None] / 2
        one = np.hstack([a, half(a), np.ones((len(a), 1))]).astype(np.float32)
        two = np.hstack([b, np.ones((len(b), 1)), half(b)]).astype(np.float32)
        return np.nonzero(one @ two.T >= -(budget + COARSE) / 2)  # minus half the squared distance

    def compare(table: pa.Table) -> pa.Table:
        d, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        index, cut = shared.value[d], blocks(d)
        side = table.column("side").to_numpy()
        unit = units(table.column("raw").to_pylist(), kind)
        place, rep, core, copies = rotated(unit), *(table.column(c).to_numpy() for c in ("rep", "core", "copies"))
        node = np.where(core >= 0, -1 - core, rep)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        itself = not len(second)
        second = first if itself else second
        links, label = np.zeros(len(rep), np.int64), node.copy()
        joined = []
        for lo in range(0, len(first), 1024):
            some = first[lo : lo + 1024]
            i, j = candidates(place[some][:, cut[block]], place[second][:, cut[block]], index.budget[block])
            i, j = some[i], second[j]
            kept = (rep[i] < rep[j] if itself else rep[i] != rep[j]) & ((core[i] < 0) | (core[i] != core[j]))
            i, j = i[kept], j[kept]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                apart = place[p] - place[q]
                apart = np.stack([np.einsum("ij,ij->i", apart[:, c], apart[:, c]) for c in cut], axis=1) <= np.array(index.budget)
                found = (apart.argmax(axis=1) == block) & apart[:, block] & (np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold)
                p, q = p[found], q[found]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                joined.append((p, q))
        p, q = (np.concatenate([x[n] for x in joined]) if joined else np.zeros(0, int) for n in (0, 1))
        while True:  # the least node spreads along the links
            before = label.copy()
            least = np.minimum(label[p], label[q])
            np.minimum.at(label, p, least)
            np.minimum.at(label, q, least)
            if (label == before).all():
                break
        at = pa.array(np.flatnonzero(links))
        return pa.table({"rep": pa.array(rep).take(at), "links": pa.array(links).take(at), "node": pa.array(node).take(at), "label": pa.array(label).take(at)})

    return rows.groupBy("pair").applyInArrow(compare, "rep long, links long, node long, label long")


def linked_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row for each row of ``vectors`` (``vec_id, embedding``)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine over 0, 1 at most")
    found, kind = usable(vectors)
    rows = staged(found, "vectors")
    width = np.dtype(kind).itemsize
    copies = rows.where("raw IS NOT NULL").groupBy("raw").agg(F.min("_row").alias("rep"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    distinct = staged(copies.withColumn("dims", (F.octet_length("raw") / width).cast("int")), "distinct")
    shared = rows.sparkSession.sparkContext.broadcast(fit(distinct, kind, threshold))
    placed = staged(places(distinct, shared, kind), "places")
    sizes, sides = work(placed)
    key = [*_CELL, "home", "core"]
    dealt = placed.join(small_enough(sizes), key).withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    dealt = dealt.join(small_enough(staged(sides, "sides")), [*key, "chunk"]).select("pair", "side", "rep", "copies", "core", "dims", "block")
    met = staged(compared(dealt.join(distinct.select("rep", "raw"), "rep"), shared, kind, threshold), "links")
    # the vectors of a core are one node, and their nodes are negative
    labels = connected_components(met.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct())
    own = labels.where("node >= 0").select(F.col("node").alias("rep"), F.col("component").alias("_own"))
    of_core = labels.where("node < 0").select((-1 - F.col("node")).cast("int").alias("core"), F.col("component").alias("_of_core"))
    nodes = distinct.drop("dims").join(placed.where("home AND block = 0").select("rep", "core"), "rep")
    core_sizes = nodes.where("core >= 0").groupBy("core").agg(F.sum("copies").alias("_in_core")).join(of_core, "core", "left")  # a row for each leader
    nodes = nodes.join(met.groupBy("rep").agg(F.sum("links").alias("_met")), "rep", "left").join(own, "rep", "left").join(F.broadcast(core_sizes), "core", "left")
    component = F.when(F.col("core") >= 0, F.coalesce("_of_core", -1 - F.col("core"))).otherwise(F.coalesce("_own", "rep")).alias("component")
    nodes = nodes.withColumn("component", component)
    nodes = staged(nodes.select("raw", "copies", "first_id", "component", (F.coalesce("_in_core", "copies") - 1 + F.coalesce("_met", F.lit(0))).alias("n_links")), "nodes")
    least = staged(nodes.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_n")), "components")
    ends = staged(join_counted(nodes, least, "component", "_n").select("raw", "copies", "n_links", "component_id"), "vector-links")
    linked = join_counted(rows.where("raw IS NOT NULL"), ends, "raw", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = staged(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "linked")
    release(rows, distinct, placed, sizes, met, nodes, least, ends)
    return out

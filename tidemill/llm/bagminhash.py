"""Near-duplicate documents by BagMinHash signatures of five-word shingles.

A document is a multiset of shingles. Each shingle has a Poisson process over
its weight axis, discretised at the integers and laid out in blocks that
double in width; the points of a block carry a height, and those under the
shingle's count belong to the document. Every point has a time and one of
``m`` places; a place of the signature is the earliest time there. Two
documents agree in a place with probability sum(min) / sum(max) of their
counts, the weighted Jaccard similarity. Only points up to a horizon are
drawn, which is moved on for documents with a place still empty, so the work
hardly depends on the weights.

1. One pass numbers the rows and adds a digest of the words, the bands, and a
   sketch: four bits of each place of the signature.
2. Rows with the same words are one text from here on, the first by
   (document, row).
3. In each band bucket every text is linked to the bucket's first, unless
   their numbers of shingles are too far apart for the threshold (an exact
   bound), or their sketches agree in fewer places than two texts at the
   threshold do but for one pair in some thousands. Both are looked at where
   texts meet, so a link is no row before it has passed. Links are verified on
   whole texts: multiset overlap of at least ``threshold``.
4. Buckets that hold several components after that are gone through again: all
   members of different components are compared by sizes and sketches, whatever
   the number of members. Those of up to ``CROWD`` are joined. A larger bucket
   is dealt into chunks of ``CHUNK`` rows, and a task compares two chunks, so
   only links are rows. The ``NEAREST`` partners of each text are verified
   first; then all other links between components that have stayed apart are.
5. Components of all verified links are the classes.

A key that a large part of the rows has (copies, a class, a bucket) is joined
where its rows are: see ``join_counted``.

Defined results: a text without words, or null, is alone in its class; one of
fewer than five words is a single shingle; null ids are allowed and sort
last; of repeated rows one is kept; other columns are returned as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import join_counted, numbered, of_arrays, pieces, release, shielded, slices, small_enough, staged
from tidemill.llm.components import connected_components
from tidemill.llm.shingles import bag, many_word_hashes, mix, weighted_jaccard, words

PLACES, BANDS = 64, 16
THRESHOLD = 0.8
SHINGLE = 5
#: Members of a bucket that are compared by a join; those of larger buckets are compared in chunks.
CROWD = 16
#: Rows of a chunk of a large bucket: a task holds two of them.
CHUNK = 16_384
#: Shingles of a chunk of texts that are compared by all of them.
CHUNK_SHINGLES = 2_000_000
#: Partners of a text in a large bucket that are verified before all others.
NEAREST = 4
#: Pairs of a chunk that are compared at once.
TILE = 1_000_000

#: So that sizes exactly at the threshold count as near, whatever the rounding.
_ROUNDING = 1e-9
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element its blocks: 0 is [0, 1), j is [2**(j-1), 2**j). Indexes of elements, and block numbers."""
    numbers = 1 + np.ceil(np.log2(counts)).astype(np.int64)
    element = np.repeat(np.arange(len(counts)), numbers)
    first = np.cumsum(numbers) - numbers
    return element, np.arange(len(element)) - first[element]


def signatures(documents: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """Earliest times, a row per document; infinite for one without shingles."""
    sizes = np.array([len(h) for h, _ in documents])
    times = np.full((len(documents), places), np.inf)
    if not sizes.sum():
        return times
    hashes = np.concatenate([h for h, _ in documents])
    counts = np.concatenate([c for _, c in documents]).astype(np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    weight = np.bincount(owner, counts, len(documents))
    horizon = np.where(weight > 0, places * (np.log(places) + 2) / np.maximum(weight, 1), 0.0)

    element, block = _blocks(counts)
    width = np.where(block > 0, 2.0 ** (block - 1), 1.0)
    low = np.where(block > 0, width, 0.0)
    seed = mix(hashes[element] + _GOLD * (block.astype(np.uint64) + np.uint64(1)))
    top, doc = counts[element], owner[element]
    at, drawn = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)

    def draw(i: np.ndarray) -> None:
        """The next point of each process ``i``: its time, and the bits of its place and height."""
        drawn[i] += np.uint64(1)
        bits = mix(seed[i] + _GOLD * drawn[i])
        at[i] -= np.log1p(-((bits >> np.uint64(11)) * 2.0**-53)) / width[i]

    active = np.arange(len(seed))
    draw(active)
    while True:
        due = active[at[active] <= horizon[doc[active]]]
        while len(due):
            bits = mix(mix(seed[due] + _GOLD * drawn[due]) ^ _GOLD)
            height = np.floor(low[due] + (bits >> np.uint64(32)) * 2.0**-32 * width[due])
            inside = height < top[due]
            hit = due[inside]
            np.minimum.at(times, (doc[hit], ((bits[inside] & np.uint64(0xFFFFFFFF)) % np.uint64(places)).astype(np.int64)), at[hit])
            draw(due)
            due = due[at[due] <= horizon[doc[due]]]
        short = np.isinf(times).any(axis=1) & (weight > 0)
        if not short.any():
            return times
        horizon[short] *= 2
        active = np.flatnonzero(short[doc])


def band_keys(times: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, -1)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2])
    for i in range(bits.shape[2]):
        keys = mix(keys * _GOLD + bits[:, :, i])
    return keys.view(np.int64)


def sketches(times: np.ndarray) -> np.ndarray:
    """Four bits of each of 64 places, as four numbers of 64 bits a signature: the first bits of all places, their second ones, and so on."""
    bits = mix(np.ascontiguousarray(times).view(np.uint64))
    places = np.arange(PLACES, dtype=np.uint64)
    return np.stack([np.bitwise_or.reduce((bits >> np.uint64(k) & np.uint64(1)) << places, axis=1) for k in range(4)], axis=1).view(np.int64)


def least_agreement(threshold: float) -> int:
    """Places that the sketches of two texts at the threshold share, less 3.6 standard deviations."""
    chance = threshold + (1 - threshold) / 16
    return int(PLACES * chance - 3.6 * (PLACES * chance * (1 - chance)) ** 0.5)


def _signed(texts: pa.Array) -> pa.Array:
    """The digest of the words and the band keys of each text."""
    texts = texts.to_pylist()
    digests: list = []
    keys: list = []
    drawn: list = []
    sizes: list = []
    for lo, hi in slices([len(t or "") for t in texts], 1_000_000):
        some = texts[lo:hi]
        digests += [xxhash.xxh3_128_digest(b" ".join(found)) if (found := words(t)) else None for t in some]
        bags = [bag(h, SHINGLE) for h in many_word_hashes(some)]
        times = signatures(bags)
        made = band_keys(times)
        drawn += sketches(times).tolist()
        keys += [k.tolist() if len(b[0]) else None for k, b in zip(made, bags, strict=True)]
        sizes += [int(counts.sum()) for _, counts in bags]
    return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(drawn, pa.list_(pa.int64()))], ["words", "bands", "size", "sketch"])


def _with_signatures(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _signed(texts)

    made = numbered(docs, "_tm_row").withColumn("_tm_made", of_arrays(sign, "words binary, bands array<long>, size long, sketch array<long>")("text"))
    return made.withColumns({"_tm_words": F.col("_tm_made.words"), "_tm_bands": F.col("_tm_made.bands"), "_tm_size": F.col("_tm_made.size"), "_tm_sketch": F.col("_tm_made.sketch")}).drop("_tm_made")


def verified(links: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The links (``a, b``) whose texts (``node, text``) overlap enough, with ``similarity``."""
    needed = staged(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    texts = staged(texts.join(small_enough(needed), "node", "left_semi"), "link-texts", needed)
    pairs = (
        links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_one")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("_other")), "b")
    )

    def compare(batches):
        for whole in batches:
            for batch in pieces(whole, "_one"):
                nodes = batch.column("b").to_pylist()
                ones = [bag(h, SHINGLE) for h in many_word_hashes(batch.column("_one").to_pylist())]
                # texts of one b follow each other: each is taken apart once
                firsts = [i for i, b in enumerate(nodes) if i == 0 or nodes[i - 1] != b]
                others = [bag(h, SHINGLE) for h in many_word_hashes(batch.column("_other").take(pa.array(firsts)).to_pylist())]
                found, at = [], -1
                for i, one in enumerate(ones):
                    at += at + 1 < len(firsts) and firsts[at + 1] == i
                    found.append(weighted_jaccard(one, others[at]))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    compared = pairs.select("a", "b", "_one", "_other").mapInArrow(compare, "a long, b long, similarity double")
    found = staged(compared.where(F.col("similarity") >= threshold), "verified")
    release(texts)
    return found


def _near_sizes(one, other, threshold: float):
    """Whether texts of so many shingles can overlap enough: sum(min) / sum(max) is at most the smaller size over the larger one."""
    return F.least(one, other) >= (threshold - _ROUNDING) * F.greatest(one, other)


def _may_be_near(one: tuple[str, str], other: tuple[str, str], threshold: float):
    """Whether two texts, by the columns of their sizes and sketches, may reach the threshold."""
    differing = F.lit(0).cast("long")
    for i in range(4):
        differing = differing.bitwiseOR(F.get(one[1], F.lit(i)).bitwiseXOR(F.get(other[1], F.lit(i))))
    return _near_sizes(one[0], other[0], threshold) & (PLACES - F.bit_count(differing) >= least_agreement(threshold))


def _pairs(groups: DataFrame, group: str, threshold: float) -> DataFrame:
    """Links between texts of different components that their sizes allow, in groups of ``CROWD`` members at most."""
    one = groups.select(group, F.col("node").alias("b"), F.col("component").alias("_b"), F.col("size").alias("_m"), F.col("sketch").alias("_p"))
    other = groups.select(group, F.col("node").alias("a"), F.col("component").alias("_a"), F.col("size").alias("_n"), F.col("sketch").alias("_q"))
    return one.join(other, group).where("b < a and _a != _b").where(_may_be_near(("_m", "_p"), ("_n", "_q"), threshold)).select("a", "b")


def _sized(groups: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Of groups with several components, the members of those with ``CROWD`` members at most, and those of larger ones."""
    counted = groups.groupBy(group).agg(F.min("component").alias("_x"), F.max("component").alias("_y"), F.count("*").alias("_n"))
    mixed = staged(counted.where("_x != _y").select(group, "_n"), "mixed")
    members = staged(join_counted(groups, mixed, group, "_n"), "mixed-members", mixed)
    return members.where(F.col("_n") <= CROWD), members.where(F.col("_n") > CROWD)


def _near_members(node: np.ndarray, component: np.ndarray, size: np.ndarray, sketch: np.ndarray, chunk: np.ndarray, threshold: float, closest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components whose sizes and sketches allow a link, of different chunks if there are two; ``closest`` leaves each row its ``NEAREST`` partners."""
    order = np.argsort(size, kind="stable")
    node, component, size, sketch, chunk = node[order], component[order], size[order], sketch[order], chunk[order]
    component = np.unique(component, return_inverse=True)[1]
    least, bound, two = least_agreement(threshold), threshold - _ROUNDING, chunk.min() != chunk.max()
    # rows of the largest component meet all others as partners
    rows, at = np.flatnonzero(component != np.bincount(component).argmax()), 0
    while at < len(rows):
        low = int(np.searchsorted(size, bound * size[rows[at]]))
        tile = rows[at : at + max(1, TILE // (len(node) - low))]
        at += len(tile)
        high = int(np.searchsorted(size, size[tile[-1]] / bound * (1 + _ROUNDING), "right"))
        partners = slice(low, high)
        apart = np.zeros((len(tile), high - low), np.uint64)
        for k in range(4):
            apart |= sketch[tile, k][:, None] ^ sketch[partners, k][None, :]
        apart = np.bitwise_count(apart)
        near = apart <= PLACES - least
        near &= component[tile][:, None] != component[partners][None, :]
        near &= np.minimum(size[tile][:, None], size[partners][None, :]) >= bound * np.maximum(size[tile][:, None], size[partners][None, :])
        if two:
            near &= chunk[tile][:, None] != chunk[partners][None, :]
        if closest and high - low > NEAREST:
            best = np.argpartition(np.where(near, apart, PLACES + 1), NEAREST - 1, axis=1)[:, :NEAREST]
            x, k = np.nonzero(np.take_along_axis(near, best, axis=1))
            y = best[x, k]
        else:
            x, y = np.nonzero(near)
        x, y = tile[x], y + low
        yield np.maximum(node[x], node[y]), np.minimum(node[x], node[y])


def _dealt(groups: DataFrame, chunks: F.Column, *more: str) -> DataFrame:
    """Rows by pairs of the ``chunks`` of their bucket, so that any two of a bucket meet."""
    dealt = groups.withColumn("_chunks", F.ceil(chunks).cast("long")).withColumn("_c", F.pmod(F.xxhash64("node"), "_chunks"))
    dealt = dealt.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    return dealt.select("bucket", F.least("_c", "_d").alias("_i"), F.greatest("_c", "_d").alias("_j"), "_c", "node", "component", "size", "sketch", *more)


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray]]:
    """A group's table, and its ``node, component, size, sketch, _c``."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    node, component, size, chunk = (table.column(c).to_numpy() for c in ("node", "component", "size", "_c"))
    return table, [node, component, size, table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 4), chunk]


def _crowds(groups: DataFrame, threshold: float, closest: bool) -> DataFrame:
    """Links between texts of different components that their sizes and sketches allow, in groups (``bucket``, of ``_n`` members) of any size."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _near_members(*_columns(batches)[1], threshold, closest):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(groups, F.col("_n") / CHUNK).groupBy("bucket", "_i", "_j").applyInArrow(link, "a long, b long")


def _partnered(groups: DataFrame, threshold: float) -> DataFrame:
    """``bucket, node`` of the members that a link of ``_crowds`` has."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (node, *columns) = _columns(batches)
        met = np.zeros(len(node), bool)
        for a, b in _near_members(np.arange(len(node)), *columns, threshold, False):
            met[a] = met[b] = True
        yield from table.select(["bucket", "node"]).filter(pa.array(met)).to_batches()

    return _dealt(groups, F.col("_n") / CHUNK).groupBy("bucket", "_i", "_j").applyInArrow(meet, "bucket long, node long").distinct()


def _bags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The shingles of each text as 64-bit numbers, a repeated one by its occurrence."""
    for batch in batches:
        texts, out = batch.to_pylist(), []
        for lo, hi in slices([len(t or "") for t in texts], 1_000_000):
            for hashes, counts in (bag(h, SHINGLE) for h in many_word_hashes(texts[lo:hi])):
                occurrence = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                out.append(mix(np.repeat(hashes, counts) + _GOLD * occurrence.astype(np.uint64)).tobytes())
        yield pa.array(out, pa.binary())


def _joining(component: np.ndarray, size: np.ndarray, sketch: np.ndarray, chunk: np.ndarray, shingles: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Of the pairs of rows that ``_near_members`` gives and whose shingles overlap enough, as many as join all their components."""
    lengths = np.array([len(x) for x in shingles])
    kinds, flat = np.unique(np.concatenate(shingles), return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    mark, label = np.zeros(len(kinds), bool), np.unique(component, return_inverse=True)[1]
    found = []
    for closest in (True, False):
        for a, b in _near_members(np.arange(len(component)), component, size, sketch, chunk, threshold, closest):
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            for lo, hi in pairwise([*np.flatnonzero(np.diff(a, prepend=-1)).tolist(), len(a)]):
                one, others = int(a[lo]), b[lo:hi]
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                mine = flat[starts[one] : starts[one] + lengths[one]]
                mark[mine] = True
                for first, behind in slices(lengths[others].tolist(), TILE):
                    some = others[first:behind]
                    ends = np.cumsum(lengths[some])
                    places = np.arange(ends[-1]) + np.repeat(starts[some] - ends + lengths[some], lengths[some])
                    shared = np.add.reduceat(mark[flat[places]], ends - lengths[some], dtype=np.int64)
                    for other in some[shared / (lengths[one] + lengths[some] - shared) >= threshold].tolist():
                        if label[other] != label[one]:
                            found.append((one, other))
                            label[label == label[other]] = label[one]
                mark[mine] = False
    return found


def _crowd_links(groups: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links that hold on the ``texts`` (``node, text``) and join what belongs together, in groups (``bucket``, of ``_n`` members) of any size."""
    met = staged(_partnered(groups, threshold), "partnered")
    nodes = staged(met.select("node").distinct(), "partners")
    bags = staged(texts.join(small_enough(nodes), "node", "left_semi").select("node", of_arrays(_bags, "binary")("text").alias("bag")), "bags", nodes)
    rows = staged(groups.drop("_n").join(met, ["bucket", "node"]), "met", met)
    total = staged(rows.groupBy("bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_all")), "met-sizes")
    placed = staged(join_counted(rows, total, "bucket", "_n"), "met-placed", rows, total)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (node, *columns) = _columns(batches)
        pairs = np.array(_joining(*columns, [np.frombuffer(x, np.uint64) for x in table.column("bag").to_pylist()], threshold), np.int64).reshape(-1, 2)
        a, b = node[pairs[:, 0]], node[pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    chunks = F.greatest(F.col("_n") / CHUNK, F.col("_all") / CHUNK_SHINGLES)
    dealt = _dealt(placed, chunks).join(bags, "node")
    return staged(dealt.groupBy("bucket", "_i", "_j").applyInArrow(link, "a long, b long").distinct(), "crowd-links", bags, placed)


def _second_look(members: DataFrame, found: DataFrame, tried: DataFrame, threshold: float, closest: bool, texts: DataFrame | None = None) -> DataFrame:
    """Links that have not been tried, between members of a bucket in different components: the closest ones of large buckets, or all that are left of them.

    With ``texts`` (``node, text``) the links of all buckets that hold on them, of large buckets as many as join what belongs together.
    """
    placed = staged(members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    few, many = _sized(placed, "bucket")
    if texts is not None:
        links = staged(_pairs(few, "bucket", threshold).distinct().join(tried, ["a", "b"], "left_anti"), "links", placed)
        held = verified(links, texts, threshold).select("a", "b")
        return held if many.isEmpty() else held.unionByName(_crowd_links(many, texts, threshold))
    links = _crowds(many, threshold, closest)
    if closest:
        links = links.unionByName(_pairs(few, "bucket", threshold))
    return staged(links.distinct().join(tried, ["a", "b"], "left_anti"), "links", placed)


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    """``_tm_words, class_id, first_row, class_size, copies``: the class of every text that has words."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id"), F.col("_tm_row").alias("row"))).alias("first")
    same = rows.where(F.col("_tm_words").isNotNull()).groupBy("_tm_words").agg(first, F.count("*").alias("copies"))
    same = staged(same.withColumn("node", F.col("first.row")), "texts")
    alone = rows.select(F.col("_tm_row").alias("node"), "_tm_bands", F.col("_tm_size").alias("size"), F.col("_tm_sketch").alias("sketch")).join(small_enough(same.select("node")), "node", "left_semi")
    bands = F.posexplode("_tm_bands").alias("band", "bucket")
    every = staged(alone.select("node", "size", "sketch", bands), "buckets")
    leaders = every.groupBy("bucket").agg(F.min(F.struct("node", "size", "sketch")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    leaders = staged(leaders.select("bucket", F.col("_first.node").alias("b"), F.col("_first.size").alias("_size"), F.col("_first.sketch").alias("_sketch"), "_n"), "leaders")
    members = staged(join_counted(every, leaders, "bucket", "_n").select("node", "size", "sketch", "band", "bucket", "b", "_size", "_sketch"), "members", leaders)
    texts = rows.select(F.col("_tm_row").alias("node"), "text")
    tried = staged(members.where("node != b").where(_may_be_near(("size", "sketch"), ("_size", "_sketch"), threshold)).select(F.col("node").alias("a"), "b").distinct(), "links")
    links = verified(tried, texts, threshold)
    found = connected_components(links)
    more = _second_look(members.drop("b", "_size", "_sketch"), found, tried, threshold, True, texts)
    if not more.isEmpty():
        release(found)
        found = connected_components(links.select("a", "b").unionByName(more))
    release(every, members)
    linked = same.join(found, "node")
    total = linked.groupBy("component").agg(F.min("first").alias("_first"), F.sum("copies").alias("class_size"), F.count("*").alias("_n"))
    linked = staged(linked, "linked")
    total = staged(total, "class-sizes")
    labelled = join_counted(linked, total, "component", "_n").select("_tm_words", F.col("_first.id").alias("class_id"), F.col("_first.row").alias("first_row"), "class_size", "copies")
    single = same.join(found, "node", "left_anti").select("_tm_words", F.col("first.id").alias("class_id"), F.col("first.row").alias("first_row"), F.col("copies").alias("class_size"), "copies")
    return staged(labelled.unionByName(single), "text-classes", linked, total, found, same)


def _decided(rows: DataFrame, threshold: float) -> DataFrame:
    """``_tm_row, doc_id, class_id, class_size, kept`` of signed rows."""
    classes = _classes(rows, threshold)
    member = rows.select("_tm_row", F.col("doc_id").cast("long").alias("doc_id"), "_tm_words")
    known = join_counted(member.where("_tm_words is not null"), classes, "_tm_words", "copies")
    known = known.select("_tm_row", "doc_id", "class_id", "class_size", (F.col("_tm_row") == F.col("first_row")).alias("kept"))
    empty = member.where("_tm_words is null").select("_tm_row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return known.unionByName(empty)


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` of each row; other columns are not looked at."""
    rows = staged(_with_signatures(docs.select("doc_id", "text")), "signed")
    return _decided(rows, threshold).drop("_tm_row")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` (it needs ``doc_id, text``), and for each row

    ``class_id`` (the smallest document of its class), ``class_size`` (rows)
    and ``kept`` (true for one row of each class). Columns of these names in
    ``docs`` are replaced.
    """
    own, names = shielded(docs)
    rows = staged(_with_signatures(own), "signed")
    decided = _decided(rows, threshold).drop("doc_id")
    return rows.drop("_tm_words", "_tm_bands", "_tm_size", "_tm_sketch", "class_id", "class_size", "kept").join(decided, "_tm_row").drop("_tm_row").withColumnsRenamed(names)


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns as they are."""
    own, names = shielded(docs)
    rows = staged(_with_signatures(own), "signed")
    gone = staged(_decided(rows, threshold).where("not kept").select("_tm_row"), "gone")
    return rows.drop("_tm_words", "_tm_bands", "_tm_size", "_tm_sketch").join(small_enough(gone), "_tm_row", "left_anti").drop("_tm_row").withColumnsRenamed(names)

"""Ranked lexical search over an index of two levels.

The upper level has a byte for each posting: the impact of the term in the
document, rounded up to a multiple of ``STEP``. Sums of these bytes bound a
score from above, and, less one step a posting, from below. The lower level has
the counts themselves, and is read for few documents:

1. Over the bytes, every task keeps the ``k`` best lower bounds per item; the
   kth best of all tasks is the item's threshold.
2. Over the bytes again, documents whose upper bound reaches the threshold are
   candidates. Whatever is among the first ``k`` is one, and so is every tie.
3. Candidates are scored by integers from the lower level, all of them.

Items are taken in blocks of about ``BLOCK_BYTES`` of terms, so that what is
broadcast has a bound, however many there are; all documents are indexed for
the terms of a block. Tasks score documents by adding the postings of an item's
terms into an array, a slice of ``SLICE`` postings at a time, so no row is made
for a pair of item and document that isn't a candidate. Documents aren't
exchanged: the postings are written once, where they were read.

Score of a document: the sum over an item's terms, repeats included, of
``w * (1e9 tf div (1000 tf + 8 m))``, with ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``
and ``m = 25 + (75 n N) div L``.

Defined results: null, empty and term-free texts, of documents and of items,
have no terms and no rows; a text of any length is split in slices; every row
of either table counts by itself, so repeated items are each reported and
repeated documents are each ranked; equal scores go by ``doc_id``, null last;
empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import numbered, pieces, release, slices, small_enough, staged

#: What an impact can be at most, and what a byte stands for.
MOST_IMPACT = 1_000_000
STEP = -(-MOST_IMPACT // 255)
#: Bytes of the terms of items that are searched for at once.
BLOCK_BYTES = 8 << 20
#: Postings that a task scores at once, and bytes of a text that it splits at once.
SLICE = 2_000_000
TEXT_SLICE = 4_000_000

_NO_TERM = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(ascii_uppercase.encode() + _NO_TERM, ascii_lowercase.encode() + b" " * len(_NO_TERM))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice at a time: letters, digits and what isn't ASCII, A-Z lower-cased."""
    plain = (text or b"").translate(_TABLE)
    start = 0
    while len(plain) - start > TEXT_SLICE:
        cut = plain.rfind(b" ", start, start + TEXT_SLICE)
        cut = plain.find(b" ", start + TEXT_SLICE) if cut < 0 else cut
        if cut < 0:
            break
        yield plain[start:cut].split()
        start = cut + 1
    yield plain[start:].split()


@dataclass
class Items:
    """A block of items: for each the numbers of its terms in the vocabulary, and how often it has them."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]


def item_terms(items: DataFrame) -> DataFrame:
    """``_item, item_id, term, times``: a row for each term of an item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [Counter(t for run in terms(text) for t in run) for text in part.column("text").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
                made = [part.column("_item").take(rows), part.column("item_id").take(rows), pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["_item", "item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = numbered(items.select("item_id", F.col("text").cast("binary").alias("text")), "_item")
    return rows.mapInArrow(split, f"_item long, item_id {kind}, term binary, times long")


def item_blocks(of_items: DataFrame, block_bytes: int) -> Iterator[Items]:
    """The staged terms of items in blocks of about so many bytes."""
    total = of_items.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    for block in range(n):
        rows = of_items.where(F.pmod(F.xxhash64("_item"), F.lit(n)) == block).collect()  # a block's terms
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        by_item: dict[int, list] = {}
        for r in rows:
            by_item.setdefault(r["_item"], [r["item_id"], [], []])
            by_item[r["_item"]][1].append(vocabulary.setdefault(bytes(r["term"]), len(vocabulary)))
            by_item[r["_item"]][2].append(r["times"])
        found = list(by_item.values())
        yield Items([f[0] for f in found], vocabulary, [np.array(f[1]) for f in found], [np.array(f[2]) for f in found])


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The lower level: ``_row, doc_id, n, terms, counts``, a row for each document that has a term of any kind."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for part in pieces(batch, "text"):
                found, lengths = [], []
                for text in part.column("text"):
                    counts: Counter = Counter()
                    n = 0
                    for run in terms(text.as_py()):
                        counts.update(map(number, run))
                        n += len(run)
                    counts.pop(None, None)
                    found.append(counts)
                    lengths.append(n)
                ends = pa.array(np.cumsum([0, *(len(c) for c in found)]), pa.int32())
                listed = [
                    pa.ListArray.from_arrays(ends, pa.array([t for c in found for t in c], pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array([n for c in found for n in c.values()], pa.int32())),
                ]
                made = pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), pa.array(lengths, pa.int64()), *listed], ["_row", "doc_id", "n", "terms", "counts"])
                yield made.filter(pa.array(np.array(lengths) > 0))

    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), "_row")
    return rows.mapInArrow(index, "_row long, doc_id long, n long, terms array<int>, counts array<int>")


def impacts(n: np.ndarray, tf: np.ndarray, rows: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times in a document of ``n`` terms is worth, without the term's weight."""
    m = 25 + 75 * n * rows // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def term_weight(rows: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the size of each list."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy(zero_copy_only=False))


def quantised(lower: DataFrame, rows: int, total: int) -> DataFrame:
    """The upper level: ``_row, terms, bytes`` of the documents that have a term of the vocabulary."""

    def round_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes = _flat(batch, "counts")
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            coarse = -(-impacts(n, counts.astype(np.int64), rows, total) // STEP)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(coarse.astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("terms"), packed], ["_row", "terms", "bytes"])

    return lower.where(F.size("terms") > 0).mapInArrow(round_up, "_row long, terms array<int>, bytes binary")


def _scored(batches: Iterator[pa.RecordBatch], items: Items, weights: list[np.ndarray], least: bool) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(item, slice of documents, a bound of the score of each), with postings sorted by term once a slice."""
    for batch in batches:
        for lo, hi in slices(np.diff(batch.column("terms").offsets.to_numpy(zero_copy_only=False)).tolist(), SLICE):
            part = batch.slice(lo, hi - lo)
            numbers, sizes = _flat(part, "terms")
            coarse = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8).astype(np.int64)
            worth = np.where(coarse > 0, (coarse - 1) * STEP + 1, 0) if least else coarse * STEP
            order = np.argsort(numbers, kind="stable")
            worth, owner = worth[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            ends = np.searchsorted(numbers[order], np.arange(len(items.vocabulary) + 1))
            for i, (known, weight) in enumerate(zip(items.terms, weights, strict=True)):
                bound = np.zeros(len(sizes), np.int64)
                for t, w in zip(known.tolist(), weight.tolist(), strict=True):
                    some = slice(ends[t], ends[t + 1])
                    bound[owner[some]] += w * worth[some]  # a document is there once for a term
                yield i, part, bound


def thresholds(upper: DataFrame, shared, k: int) -> list[int]:
    """For each item the kth best lower bound of all documents, or 1 if fewer than ``k`` have one."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        kept = np.zeros((len(items.ids), k), np.int64)
        for i, _, bound in _scored(batches, items, weights, least=True):
            both = np.concatenate([kept[i], bound])
            kept[i] = np.partition(both, len(both) - k)[-k:]
        at, place = np.nonzero(kept)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(kept[at, place])], ["item", "bound"])

    found = upper.select("terms", "bytes").mapInArrow(best, "item int, bound long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))
    reached = found.withColumn("_place", place).where(F.col("_place") <= k).groupBy("item").agg(F.min("bound").alias("bound"), F.count("*").alias("n"))
    least = [1] * len(shared.value[0].ids)
    for r in reached.where(F.col("n") == k).collect():  # a row for each item of the block
        least[r["item"]] = max(1, r["bound"])
    return least


def candidates(upper: DataFrame, shared, least: list[int]) -> DataFrame:
    """``_row, item`` wherever the upper bound reaches the item's threshold."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        for i, part, bound in _scored(batches, items, weights, least=False):
            at = np.flatnonzero(bound >= least[i])
            if len(at):
                yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(at)), pa.array(np.full(len(at), i, np.int32))], ["_row", "item"])

    return upper.mapInArrow(reach, "_row long, item int")


def rescored(lower: DataFrame, found: DataFrame, shared, rows: int, total: int, kind: str) -> DataFrame:
    """``item, item_id, doc_id, score`` of candidates, by the counts themselves."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        known = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in zip(items.terms, weights, strict=True)]
        for batch in batches:
            out = []
            for n, numbers, counts, wanted in zip(*(batch.column(c).to_pylist() for c in ("n", "terms", "counts", "items")), strict=True):
                worth = impacts(np.array(n), np.array(counts, np.int64), rows, total).tolist()
                for i in wanted:
                    weight = known[i].get
                    out.append(sum(weight(t, 0) * x for t, x in zip(numbers, worth, strict=True)))
            wanted, sizes = _flat(batch, "items")
            made = [pa.array(wanted), pa.array([items.ids[i] for i in wanted]), batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["item", "item_id", "doc_id", "score"])

    # a document has at most the items of the block
    asked = staged(found.groupBy("_row").agg(F.collect_list("item").alias("items")), "candidates")
    return lower.join(small_enough(asked), "_row").mapInArrow(score, f"item int, item_id {kind}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``items`` (``item_id, text``)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    of_items = staged(item_terms(items), "item-terms")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(of_items, block_bytes):
        lower = staged(postings(docs, block.vocabulary), "postings")
        rows, total = lower.agg(F.count("*"), F.sum("n")).first()
        if not rows:
            continue
        dfs = lower.select(F.explode("terms").alias("term")).groupBy("term").count()
        df = {r["term"]: r["count"] for r in dfs.collect()}  # a row for each term of the block
        weight = np.array([term_weight(rows, df.get(t, 0)) for t in range(len(block.vocabulary))], np.int64)
        shared = spark.sparkContext.broadcast((block, [weight[t] * n for t, n in zip(block.terms, block.times, strict=True)]))
        upper = staged(quantised(lower, rows, total), "impacts")
        found = candidates(upper, shared, thresholds(upper, shared, k))
        exact = rescored(lower, found, shared, rows, total, kind).where("score > 0")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = exact.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(staged(best, "ranked"))
        release(lower, upper)
    release(of_items)
    return out

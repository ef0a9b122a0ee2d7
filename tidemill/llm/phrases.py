"""Phrases whose words stand together more often than their parts let expect, by hashed bucket counts and Apriori pruning.

Passes over the corpus, for phrases of one word more each time:

- A pass counts the phrases of ``k`` words exactly, and at the same time throws
  those of ``k + 1`` words into ``2 ** bits`` buckets: each into one of either
  half, by hashes of their own, so that a rare phrase has to meet frequent ones
  twice to be taken for one. A task has one array of counts that end at the
  support, and what tasks have is added up a segment of buckets at a time.
  Buckets that reach the support are a bitmap.
- The frequent phrases of ``k`` words are a second bitmap, of the same hash.
- Both bitmaps are broadcast; ``bits`` bounds their size, whatever the corpus.
  A phrase of ``k + 1`` words is counted only if its buckets reach the support
  and both of its parts of ``k`` words are in the other bitmap. Hashes that
  meet cost time and change nothing, since counts are of the phrases themselves.

Behind the first pass the corpus is trimmed to the runs of words that may be
in a phrase of two, which is a small part of it; later passes read that alone.
It is dealt by language, large languages to many tasks.

Parts of a frequent phrase are frequent, so the scores are joins of the
frequent phrases with themselves. A phrase goes if a longer one is as frequent:
if any is, one that is a single word longer is, so only those are looked at.

Defined results: null and empty texts have no words; a null language is
``und``; texts of any length are read a slice at a time, with the last words of
a slice in front of the next where no piece ends; repeated rows count each;
equal scores go by frequency, then by the phrase's bytes; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import pieces, release, staged
from tidemill.llm.shingles import mix

SUPPORT = 100
MOST_WORDS = 5
LIMIT = 2000

#: What ends a piece, and what else ends a word.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(ascii_uppercase.encode() + PIECE_ENDS + b"\t", ascii_lowercase.encode() + b"\n" * len(PIECE_ENDS) + b" ")
#: Bytes that a task splits at once, buckets of a row on the way, and entries of a task's table of counts.
SLICE = 2_000_000
SEGMENT = 1 << 14
MOST_COUNTS = 300_000
#: Buckets, as a power of two: about one for each so many bytes, within bounds.
BYTES_PER_BUCKET = 64
BITS = (16, 26)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = 0xD6E8FEB86659FD93
_COUNTS = "lang string, phrase binary, n long, segment int, counts binary"


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, np.uint64(_FACTOR)), np.full(n, np.uint64(pow(_FACTOR, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """The words of a buffer of pieces; the first ``skip`` of them were counted with the buffer before."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    skip: int
    seed: np.uint64

    @classmethod
    def of(cls, data: bytes, lang: str, skip: int = 0) -> Words:
        raw = np.frombuffer(data, np.uint8)
        breaks = raw == 10
        inside = np.concatenate([[False], ~(breaks | (raw == 32)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        return cls(data, start, end, np.cumsum(breaks, dtype=np.int64)[start], skip, np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))

    def hashes(self) -> np.ndarray:
        """A number for each word, of its bytes."""
        raw = np.frombuffer(self.data, np.uint8)
        up, down = _powers(1 << len(raw).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + self.seed)

    def together(self, k: int) -> np.ndarray:
        """For each word, whether ``k`` from it on stand in one piece, the last of them not yet counted."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        return (self.piece[k - 1 :] == self.piece[:n]) & (np.arange(k - 1, n + k - 1) >= self.skip)

    def phrases(self, at: np.ndarray, k: int) -> list[bytes]:
        """The bytes of ``k`` words from each place on; their words are one space apart."""
        data = self.data
        return [data[s:e] for s, e in zip(self.start[at].tolist(), self.end[at + k - 1].tolist(), strict=True)]


def longer(hashes: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the phrases of ``k`` words from those of one word less."""
    return mix(hashes[: len(words) - k + 1] * _BASE + words[k - 1 :])


def buffers(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    """The texts of a batch by language, as words of about ``SLICE`` bytes."""
    for part in pieces(batch, "text", SLICE):
        by_lang = defaultdict(list)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            if text:
                by_lang[lang].append(text.translate(_TABLE))
        for lang, texts in by_lang.items():
            for data, skip in cut(b"\n".join(texts)):
                yield lang, Words.of(data, lang, skip)


def cut(data: bytes) -> Iterator[tuple[bytes, int]]:
    """Slices of a buffer at ends of pieces, or of words, and then how many words in front are of the slice before."""
    start, kept, skip = 0, b"", 0
    while len(data) - start > SLICE:
        at = data.rfind(b"\n", start + 1, start + SLICE)
        piece = at >= 0
        if not piece:
            at = data.rfind(b" ", start + 1, start + SLICE)
            at = min((x for x in (data.find(b" ", start + SLICE), data.find(b"\n", start + SLICE)) if x >= 0), default=-1) if at < 0 else at
        if at < 0:
            break
        yield kept + data[start:at], skip
        # a phrase that goes on needs all of its words but one
        last = [] if piece else (kept + data[start:at]).rpartition(b"\n")[2].split()[1 - MOST_WORDS :]
        kept, skip, start = b" ".join(last) + b" ", len(last), at
    yield kept + data[start:], skip


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each phrase in the lower half and in the upper half."""
    down = np.uint64(65 - bits)
    return (hashes >> down).astype(np.int64), (mix(hashes ^ _BASE) >> down).astype(np.int64) + (1 << bits - 1)


class Buckets:
    """How many phrases fell into each bucket, up to ``support``."""

    def __init__(self, bits: int, support: int):
        self.bits, self.support = bits, support
        self.counts = np.zeros(1 << bits, np.min_scalar_type(support))

    def add(self, hashes: np.ndarray, n: int = 1) -> None:
        for half in places(hashes, self.bits):
            at, times = np.unique(half, return_counts=True)
            self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + n * times, self.support)

    def rows(self) -> Iterator[pa.RecordBatch]:
        each = self.counts.reshape(-1, min(SEGMENT, len(self.counts)))
        used = np.flatnonzero(each.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 256)):
            yield _row(segments=some, counts=[each[s].tobytes() for s in some])


def _row(lang: str | None = None, counter: Counter | None = None, segments=(), counts=()) -> pa.RecordBatch:
    counter = counter or {}
    nothing = [None] * len(segments)
    columns = [
        pa.array([lang] * len(counter) + nothing, pa.string()), pa.array([*counter, *nothing], pa.binary()), pa.array([*counter.values(), *nothing], pa.int64()),
        pa.array([*[None] * len(counter), *segments], pa.int32()), pa.array([*[None] * len(counter), *counts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "segment", "counts"])


def bitmap(rows: DataFrame, bits: int, support: int) -> np.ndarray:
    """The buckets that reach the support, as bits; ``rows`` has what tasks counted, by segment."""
    kind = np.min_scalar_type(support)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[segment] = sums.get(segment, 0) + np.frombuffer(counts, kind).astype(np.int64)
        packed = [np.packbits(s >= support, bitorder="little").tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["segment", "bits"])

    added = rows.where("segment IS NOT NULL").select("segment", "counts").repartition("segment").mapInArrow(add, "segment int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = min(SEGMENT, 1 << bits) // 8
    for r in added.collect():  # 2 ** bits bits in all
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both buckets of a phrase are in the bitmap."""
    one, two = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in places(hashes, (len(bits) * 8).bit_length() - 1))
    return (one & two) > 0


def first_pass(texts: DataFrame, bits: int, support: int) -> DataFrame:
    """Counts of words, and of pairs by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, found = Buckets(bits, support), defaultdict(Counter)
        for batch in batches:
            for lang, words in buffers(batch):
                found[lang].update(words.data.split()[words.skip :])
                each = words.hashes()
                buckets.add(longer(each, each, 2)[words.together(2)])
                if sum(map(len, found.values())) > MOST_COUNTS:
                    yield from (_row(lang, c) for lang, c in found.items())
                    found.clear()
        yield from (_row(lang, c) for lang, c in found.items())
        yield from buckets.rows()

    return texts.mapInArrow(count, _COUNTS)


def trimmed(texts: DataFrame, words_: Broadcast, pairs_: Broadcast) -> DataFrame:
    """``lang, text, skip``: the runs of words that may be in a phrase of two, a line each, words one space apart."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in buffers(batch):
                each = words.hashes()
                if len(each) < 2:
                    continue
                known = _set(words_.value, each)
                pair = (words.piece[1:] == words.piece[:-1]) & known[1:] & known[:-1]
                pair[pair] = _set(pairs_.value, longer(each, each, 2)[pair])
                ahead, behind = np.append(pair, False), np.append(False, pair)
                kept = np.flatnonzero(ahead | behind)
                if not len(kept):
                    continue
                # a word's bytes and the one behind it, which becomes a space or the end of the run
                sizes = words.end[kept] - words.start[kept] + 1
                ends = np.cumsum(sizes)
                take = np.arange(ends[-1]) + np.repeat(words.start[kept] - (ends - sizes), sizes)
                out = np.append(np.frombuffer(words.data, np.uint8), np.uint8(10))[take]
                out[ends - 1] = np.where(ahead[kept], 32, 10)
                made = [pa.array([lang]), pa.array([out.tobytes()], pa.binary()), pa.array([int((kept < words.skip).sum())], pa.int32())]
                yield pa.RecordBatch.from_arrays(made, ["lang", "text", "skip"])

    return texts.mapInArrow(trim, "lang string, text binary, skip int")


def later_pass(runs: DataFrame, k: int, parts: dict[int, Broadcast], buckets_: dict[int, Broadcast], bits: int, support: int, last: bool) -> DataFrame:
    """Counts of the phrases of ``k`` words that may be frequent, and of those of one more by bucket.

    ``parts`` has the bitmap of frequent phrases by number of words, ``buckets_`` that of buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, found = Buckets(bits, support), defaultdict(Counter)
        for batch in batches:
            for lang, text, skip in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "skip")), strict=True):
                words = Words.of(text, lang, 0)
                each = words.hashes()
                may, hashes = words.together(2), longer(each, each, 2)
                for j in range(3, k + 1):
                    both = may[:-1] & may[1:]
                    both[both] &= (_set(parts[j - 1].value, hashes[:-1]) & _set(parts[j - 1].value, hashes[1:]))[both]
                    hashes = longer(hashes, each, j)
                    both[both] = _set(buckets_[j].value, hashes[both])
                    may = both
                new = np.arange(k - 1, len(may) + k - 1) >= skip
                found[lang].update(words.phrases(np.flatnonzero(may & new), k))
                if not last and len(may) > 1:
                    buckets.add(longer(hashes, each, k + 1)[may[:-1] & may[1:] & new[1:]])
                if sum(map(len, found.values())) > MOST_COUNTS:
                    yield from (_row(lang, c) for lang, c in found.items())
                    found.clear()
        yield from (_row(lang, c) for lang, c in found.items())
        yield from buckets.rows()

    return runs.mapInArrow(count, _COUNTS)


def of_frequent(frequent: DataFrame, k: int, bits: int, support: int) -> DataFrame:
    """The frequent phrases themselves, thrown into buckets that they fill."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits, support)
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                by_lang[lang].append(phrase)
            for lang, some in by_lang.items():
                words = Words.of(b"\n".join(some), lang)
                hashes = each = words.hashes()
                for j in range(2, k + 1):
                    hashes = longer(hashes, each, j)
                buckets.add(hashes[words.together(k)], support)
        yield from buckets.rows()

    return frequent.select("lang", "phrase").mapInArrow(fill, _COUNTS)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, n`` of all phrases that occur ``support`` times, and ``lang, n``, the words of each language."""
    if not 2 <= most_words <= MOST_WORDS:
        raise ValueError(f"phrases have 2 to {MOST_WORDS} words")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    if bits is None:
        n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max((n_bytes // BYTES_PER_BUCKET).bit_length(), BITS[0]), BITS[1])
    share = docs.sparkSession.sparkContext.broadcast
    parts: dict[int, Broadcast] = {}
    buckets: dict[int, Broadcast] = {}
    runs, found, sizes = texts, [], None
    for k in range(1, most_words + 1):
        if k == 2:
            # languages apart, as far as their sizes allow: a phrase is then in the counts of few tasks
            runs = staged(trimmed(texts, parts[1], buckets[2]).hint("rebalance", "lang"), "trimmed")
        counted = first_pass(texts, bits, support) if k == 1 else later_pass(runs, k, parts, buckets, bits, support, k == most_words)
        counted = staged(counted, f"counts-{k}")
        phrases = counted.where("segment IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            sizes = staged(phrases.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
        frequent = staged(phrases.where(F.col("n") >= support), f"frequent-{k}")
        found.append(frequent.select("lang", F.lit(k).alias("size"), F.col("phrase").cast("string").alias("phrase"), "n"))
        if k < most_words:
            buckets[k + 1] = share(bitmap(counted, bits, support))
            parts[k] = share(bitmap(of_frequent(frequent, k, bits, support), bits, support))
        release(counted)
    release(runs)
    every = found[0]
    for some in found[1:]:
        every = every.unionByName(some)
    return every, sizes


def scored(frequent: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of all candidates that no longer one accounts for."""
    words = F.split("phrase", " ")
    candidates = frequent.where("size > 1").withColumn("_words", words)
    part = lambda at, n: F.array_join(F.slice("_words", at, n), " ")
    cuts = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "_k", part(F.lit(1), F.col("_k")).alias("_first"), part(F.col("_k") + 1, F.col("size")).alias("_rest"))
    first = frequent.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l"))
    rest = frequent.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r"))
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"({wide(1000)} * {wide('a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})").alias("score")
    valued = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).join(sizes, "lang").select("lang", "phrase", "a", "n", "_k", "l", "r", score)
    lowest = valued.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
    ends = F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size"))))
    inside = candidates.where("size > 2").select("lang", ends.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    own = lowest.join(inside, ["lang", "phrase"], "left").where("_longer IS NULL OR _longer < a")
    return own.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def collocations(docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS, limit: int = LIMIT, bits: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``limit`` phrases."""
    frequent, sizes = frequent_phrases(docs, support, most_words, bits)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(staged(frequent, "frequent"), sizes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

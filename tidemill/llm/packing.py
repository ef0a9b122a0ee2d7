"""Best-fit packing by a linear grouping scheme.

Documents become token pieces of at most ``capacity`` tokens. What is packed
is described by the number of pieces of each length, at most ``capacity``
figures however large the corpus, so the packing itself is computed from that
histogram alone:

1. full pieces get a sequence each;
2. large lengths, in falling order, are cut into groups of equal cardinality
   and rounded up to the largest of their group, which leaves few sizes;
3. configurations of those sizes are chosen, each the fullest that holds the
   largest size left, and repeated as long as the demand lasts;
4. actual pieces take the places of the rounded ones, which frees space;
5. small lengths go, largest first, where they fit best.

The result is a list of runs "pieces of length l with ranks a to b go to
sequences s, s+1, ... at offset o". Spark ranks the pieces of each length
(salted, so that no length meets in one task) and looks up their run.

Defined results: a null text counts as empty and still yields its end token;
repeated rows are separate documents; ties are broken by document, piece and
row number; an empty table gives an empty result; other columns of the input
are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import documents, numbered, pieces, staged
from tidemill.llm.wordcache import WordCache, kept

TOKENIZER = "byte_bpe_50k.json"
END_TOKEN = 2
#: Words whose ids a worker remembers, about 200 bytes each.
MOST_WORDS = 400_000
#: Runs of a plan that are broadcast at most, about 50 bytes each.
MOST_RUNS = 100_000
GROUPS = 1024
#: Lengths under this part of the capacity are small.
SMALL = 1 / 16
#: Pieces of one length that one task ranks, if lengths were all alike.
RANKED_PER_BUCKET = 200_000

PIECES = "_row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class Vocabulary:
    """A byte-level BPE vocabulary, read from its ``tokenizers`` file.

    Words are merged by tiktoken, which gives the same ids in a quarter of the
    time. It doesn't know the tokens that the file adds to the merges, so
    ``tokenizers`` itself encodes texts that hold one.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        ranks = {_token_bytes(token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in self.added}
        ranks = {token: i for token, i in ranks.items() if token is not None}
        self.model = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return array("I", self.model.encode_ordinary(text)).tobytes()

    def ids_with_added(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


class TextEncoder:
    """Token ids of whole texts, found word by word.

    A byte-level BPE vocabulary splits texts before it merges, and always
    between a character that is no white space and a single space. So texts
    are cut there; one with other white space around a cut, or with an added
    token, is encoded whole.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.heads = WordCache(lambda words: self._encode(words, ""), MOST_WORDS)
        self.rest = WordCache(lambda words: self._encode(words, " "), MOST_WORDS)

    def _encode(self, words: list[str], before: str) -> list[bytes | None]:
        return [None if not w or w[0].isspace() or w[-1].isspace() else self.vocabulary.ids(before + w) for w in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        self.heads.trim()
        self.rest.trim()
        heads, rest = self.heads, self.rest
        special = [any(a in t for a in self.vocabulary.added) for t in texts]
        numbers = []
        for text, odd in zip(texts, special, strict=True):
            head, *words = [""] if odd else text.split(" ")
            numbers.append((heads[head], [rest[w] for w in words]))
        heads.fill()
        rest.fill()
        out = []
        for text, odd, (head, words) in zip(texts, special, numbers, strict=True):
            if odd:
                out.append(self.vocabulary.ids_with_added(text))
                continue
            ids = [heads.ids[head], *[rest.ids[w] for w in words]]
            out.append(self.vocabulary.ids(text) if None in ids else b"".join(ids))
        return out


def _token_bytes(token: str) -> bytes | None:
    """The bytes that a byte-level vocabulary writes as printable characters."""
    try:
        return bytes(_BYTE_OF[c] for c in token)
    except KeyError:
        return None


def _printable() -> dict[str, int]:
    """Printable character -> byte: Latin-1's own, and from U+0100 on for the others in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


_BYTE_OF = _printable()


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """A row per piece: row number, document, piece, start, length, CRC-32 of its ids.

    Only documents over ``capacity`` tokens are cut; their first piece takes
    the remainder. ``with_ids`` adds the token ids.
    """
    from public_tokenizers import path

    model_path = tokenizer or path(TOKENIZER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept((__name__, model_path), lambda: TextEncoder(model_path))
        last = end.to_bytes(4, "little")
        for batch in (piece for whole in batches for piece in pieces(whole, "text", 1_000_000)):
            rows, ids = batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            held: list[bytes] = []
            for i, tokens in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                view, n, start, piece = memoryview(tokens + last), len(tokens) // 4 + 1, 0, 0
                length = n % capacity or min(n, capacity)
                while start < n:
                    part = view[4 * start : 4 * (start + length)]
                    out.append((rows[i], ids[i], piece, start, length, zlib.crc32(part)))
                    if with_ids:
                        held.append(bytes(part))
                    start, piece, length = start + length, piece + 1, capacity
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array([list(memoryview(x).cast("I")) for x in held], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = numbered(documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "_row")
    return rows.mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


class _Bins:
    """Open sequences, as runs of neighbours with the same space left; ``runs`` is the result."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.space: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.runs: list[tuple[int, int, int, int, int]] = []

    def open(self, n: int) -> tuple[int, int]:
        self.count += n
        return self.count - n, n

    def put(self, length: int, rank: int, n: int, first: int, space: int) -> None:
        """``n`` pieces into the sequences from ``first`` on, each with ``space`` left."""
        self.runs.append((length, rank, rank + n, first, self.capacity - space))


def _groups(counts: list[tuple[int, int]], most: int) -> list[list[list[int]]]:
    """Falling (length, count) in at most ``most`` groups of equal cardinality, as [length, count, first rank]."""
    each = max(1, -(-sum(n for _, n in counts) // most))
    groups: list[list[list[int]]] = [[]]
    room = each
    for length, n in counts:
        rank = 0
        while n:
            take = min(n, room)
            groups[-1].append([length, take, rank])
            n, rank, room = n - take, rank + take, room - take
            if not room:
                groups.append([])
                room = each
    return [g for g in groups if g]


def _fullest(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """Group -> how often, in the fullest sequence that holds the largest size left."""
    first = next(g for g, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for g in range(first, len(sizes)):
        have = left[g] - (g == first)
        for _ in range(min(have, room // sizes[g])):
            grown = (reach | reach << sizes[g]) & mask
            if grown == reach:
                break
            layers.append((g, reach))
            reach = grown
    at, used = reach.bit_length() - 1, {first: 1}
    for g, before in reversed(layers):
        if not before >> at & 1:
            used[g] = used.get(g, 0) + 1
            at -= sizes[g]
    return used


def packing_plan(histogram: dict[int, int], capacity: int = 1024, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, rank behind the last, first sequence, offset).

    Small by construction: it grows with the number of lengths, at most
    ``capacity``, and of configurations, not with the number of pieces.
    """
    bins = _Bins(capacity)
    small_limit = max(1, int(capacity * SMALL))
    if full := histogram.get(capacity, 0):
        bins.put(capacity, 0, full, bins.open(full)[0], capacity)
    large = sorted(((k, n) for k, n in histogram.items() if small_limit <= k < capacity and n), reverse=True)
    queues = _groups(large, groups)
    sizes, left = [q[0][0] for q in queues], [sum(x[1] for x in q) for q in queues]
    while any(left):
        used = _fullest(sizes, left, capacity)
        times = min(left[g] // k for g, k in used.items())
        first, n = bins.open(times)
        parts = [(first, n, capacity)]
        for g, k in used.items():
            left[g] -= k * times
            for _ in range(k):
                parts = _substitute(bins, queues[g], parts)
        for at, n, space in parts:
            bins.space[space].append((at, n))
    spaces = sorted(s for s in bins.space if s)
    for length in sorted((k for k, n in histogram.items() if k < small_limit and n), reverse=True):
        _best_fit(bins, spaces, length, histogram[length])
    return bins.runs


def _substitute(bins: _Bins, queue: list[list[int]], parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One actual piece of the group into each sequence of ``parts``."""
    out = []
    for at, n, space in parts:
        while n:
            length, have, rank = head = queue[0]
            take = min(n, have)
            bins.put(length, rank, take, at, space)
            out.append((at, take, space - length))
            at, n = at + take, n - take
            if take == have:
                queue.pop(0)
            else:
                head[1], head[2] = have - take, rank + take
    return out


def _best_fit(bins: _Bins, spaces: list[int], length: int, n: int) -> None:
    rank = 0
    while n:
        i = bisect.bisect_left(spaces, length)
        if i == len(spaces):  # as many new sequences as these pieces fill
            each = bins.capacity // length
            bins.space[bins.capacity].append(bins.open(-(-n // each)))
            bisect.insort(spaces, bins.capacity)
            continue
        space = spaces[i]
        at, have = bins.space[space].pop()
        take = min(n, have)
        bins.put(length, rank, take, at, space)
        if take < have:
            bins.space[space].append((at + take, have - take))
        if not bins.space[space]:
            spaces.remove(space)
        if rest := space - length:
            if not bins.space[rest]:
                bisect.insort(spaces, rest)
            bins.space[rest].append((at, take))
        n, rank = n - take, rank + take


def _placed(ranked: DataFrame, starts: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """``ranked`` with the run that each piece is in.

    More runs than may be broadcast are first joined to the buckets of their
    length, a few rows each, and then by length and bucket, so that a length
    that most pieces have is not one task.
    """
    table = ranked.sparkSession.createDataFrame(runs, "length long, _low long, _high long, _first long, offset long")
    within = (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    if len(runs) <= MOST_RUNS:
        return ranked.join(F.broadcast(table.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & within)
    met = starts.join(table, "length").where((F.col("_low") < F.col("_start") + F.col("_n")) & (F.col("_high") > F.col("_start")))
    return ranked.join(met.drop("_start", "_n"), ["length", "_bucket"]).where(within)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there (see the module)."""
    made = staged(token_pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces")
    # at most ``capacity`` rows, whatever the corpus
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = packing_plan(histogram, capacity, groups)
    buckets = max(32, sum(histogram.values()) // RANKED_PER_BUCKET)
    salted = made.withColumn("_bucket", F.pmod(F.xxhash64("_row", "piece"), F.lit(buckets)))
    within = Window.partitionBy("length", "_bucket")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = (
        salted.withColumn("_place", F.row_number().over(within.orderBy("doc_id", "piece", "_row")))
        .join(starts.drop("_n"), ["length", "_bucket"])
        .withColumn("_rank", F.col("_start") + F.col("_place") - 1)
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_low")).alias("sequence_id"), "offset"]
    return _placed(ranked, starts, runs).select(*columns, *(["ids"] if with_ids else []))

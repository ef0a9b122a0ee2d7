"""Benchmark decontamination by spaced seeds; built-in functions only.

A seed is a mask over consecutive words that looks at some places and ignores
the others, so a substituted word spoils only the seeds that look at it.
Seeds of every position of the training texts are joined with those of the
benchmark. Around each hit the two texts are laid over each other, and a hit
counts if some ``WINDOW`` words (or the whole item, if shorter) agree in
``AGREE`` of their places.

The benchmark's seeds are broadcast only if they are few (they are counted
first). A hit then takes the words around it along, so texts are read and
hashed once and never exchanged. Otherwise the join is an exchange by seed,
which adaptive execution splits where a passage is hot, and texts are fetched
for the hits. Hits are made distinct per (row, item, diagonal) in either case.

``MASKS`` meet every overlap of ``WINDOW`` words with up to two substitutions,
and those with three but for 7 of 560; tests/llm enumerates them.

Defined results: null and empty texts, of documents and of items, have no
words and no hits. An item of fewer words than the longest mask is met where
all of its words stand one after another; one of fewer than ``SHORTEST`` words
only by a text that has no others, since common words would be met anywhere.
Items with equal words are each reported. Repeated documents are judged one by
one; other columns are returned by ``decontaminate`` as they are, whatever
their names, and not looked at otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import numbered, release, shielded, small_enough, staged

#: Places that a mask looks at, from the first on.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 5, 8))
_LONGEST = 1 + max(m[-1] for m in MASKS)
#: Words of an item that is looked for within texts.
SHORTEST = 4
WINDOW = 16
AGREE = 0.8
#: Seeds of the benchmark that are broadcast at most, about 24 bytes each.
MOST_BROADCAST = 1_000_000

_AROUND = 2 * WINDOW


def word_hashes(text: str = "text") -> Column:
    """Hashes of the lower-cased words (letters and digits) of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes: str = "_h") -> Column:
    """(position, seed) for each position and mask that fit."""
    none = F.array().cast("array<struct<pos:int,seed:bigint>>")

    def masked(number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(hashes) - mask[-1] - 1
        found = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(number), *(F.get(F.col(hashes), i + p) for p in mask)).alias("seed")),
        )
        return F.when(last >= 0, found).otherwise(none)

    return F.concat(*(masked(i, m) for i, m in enumerate(MASKS)))


def overlap(one: Column, other: Column, window: Column) -> Column:
    """Most agreeing places in any ``window`` neighbours of two lists laid over each other."""
    same = F.zip_with(one, other, lambda x, y: F.when(x == y, 1).otherwise(0))
    starts = F.sequence(F.lit(1), F.greatest(F.least(F.size(one), F.size(other)) - window + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(same, i, window), F.lit(0), lambda a, x: a + x)))


def _short_seeds(hashes: str, lengths: list[int]) -> Column:
    """(position, seed) of every run of as many words as a short item has."""

    def runs(n: int) -> Column:
        last = F.size(hashes) - n
        seed = lambda i: F.xxhash64(F.lit(-n), *(F.get(F.col(hashes), i + p) for p in range(n)))
        found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("pos"), seed(i).alias("seed")))
        fits = last >= 0 if n >= SHORTEST else last == 0
        return F.when(fits, found).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>"))

    return F.concat(*(runs(n) for n in lengths))


def _items(benchmark: DataFrame) -> DataFrame:
    """``rep, _item, ids``: the distinct word lists of the benchmark, each with all of its items."""
    items = benchmark.select(F.col("item_id").cast("long"), word_hashes().alias("_item")).where(F.size("_item") > 0)
    return items.groupBy("_item").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).withColumn("rep", F.monotonically_increasing_id())


def _contaminated(rows: DataFrame, benchmark: DataFrame, most_broadcast: int) -> DataFrame:
    """``_tm_row, doc_id, rep, ids, agreeing, doc_word`` of every overlap that counts; ``rows`` has ``_tm_row, doc_id, text``."""
    items = staged(_items(benchmark), "items")
    # at most as many as a mask is long
    lengths = sorted(r[0] for r in items.where(F.size("_item") < _LONGEST).select(F.size("_item")).distinct().collect())
    long = items.where(F.size("_item") >= _LONGEST).select("rep", F.inline(seeds("_item")))
    short = [items.where(F.size("_item") == n).select("rep", F.inline(_short_seeds("_item", [n]))) for n in lengths]
    for some in short:
        long = long.unionByName(some)
    wanted = staged(long.withColumnRenamed("pos", "_at"), "item-seeds")
    few = wanted.count() <= most_broadcast
    offered = rows.select("_tm_row", "doc_id", word_hashes().alias("_h"))
    every = F.concat(seeds(), _short_seeds("_h", lengths)) if lengths else seeds()
    start = F.greatest(F.lit(0), F.col("_at") - _AROUND, F.col("_at") - F.col("pos"))
    width = F.lit(2 * _AROUND + WINDOW)
    around = lambda words: F.slice(words, (F.col("_first") + F.col("_diagonal") + 1).cast("int"), width)
    place = [(F.col("pos") - F.col("_at")).alias("_diagonal"), F.floor(F.col("_at") / WINDOW).alias("_stretch"), start.alias("_first")]
    # one hit of each diagonal and stretch: two hits of a stretch see nearly the same surroundings, and the first of them is taken
    group = ["_tm_row", "doc_id", "rep", "_diagonal", "_stretch"]
    if few:
        hits = offered.select("_tm_row", "doc_id", "_h", F.inline(every)).join(F.broadcast(wanted), "seed")
        hits = hits.select("_tm_row", "doc_id", "rep", *place, "_h").withColumn("_near", around("_h")).drop("_h")
        hits = hits.groupBy(*group).agg(F.min(F.struct("_first", "_near")).alias("_hit")).select(*group, "_hit.*").join(F.broadcast(items), "rep")
    else:
        hits = offered.select("_tm_row", "doc_id", F.inline(every)).join(wanted, "seed").select("_tm_row", "doc_id", "rep", *place)
        hits = hits.groupBy(*group).agg(F.min("_first").alias("_first")).join(items, "rep")
        hits = hits.join(rows.select("_tm_row", word_hashes().alias("_h")), "_tm_row").withColumn("_near", around("_h")).drop("_h")
    window = F.when(F.size("_item") < _LONGEST, F.size("_item")).otherwise(F.least(F.lit(WINDOW), F.size("_item")))
    need = F.when(F.size("_item") < _LONGEST, F.col("_window")).otherwise(F.ceil(F.col("_window") * AGREE))
    judged = hits.withColumn("_window", window).select(
        "_tm_row", "doc_id", "rep", "ids", need.alias("_need"), (F.col("_first") + F.col("_diagonal")).alias("doc_word"),
        overlap(F.slice("_item", F.col("_first") + 1, width), F.col("_near"), F.col("_window")).alias("agreeing"),
    )
    return judged.where(F.col("agreeing") >= F.col("_need")).drop("_need")


def contamination(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``doc_id, item_id, agreeing, doc_word``: a row per document row and item it holds a passage of."""
    rows = staged(numbered(docs.select(F.col("doc_id").cast("long"), "text"), "_tm_row"), "rows")
    best = F.max(F.struct("agreeing", (-F.col("doc_word")).alias("_before"), "ids")).alias("_best")
    found = _contaminated(rows, benchmark, most_broadcast).groupBy("_tm_row", "doc_id", "rep").agg(best)
    found = found.select("doc_id", F.explode("_best.ids").alias("item_id"), F.col("_best.agreeing").cast("long").alias("agreeing"), (-F.col("_best._before")).cast("long").alias("doc_word"))
    out = staged(found, "overlaps")
    release(rows)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    own, names = shielded(docs)
    rows = staged(numbered(own, "_tm_row"), "rows")
    found = staged(_contaminated(rows.select("_tm_row", "doc_id", "text"), benchmark, most_broadcast).select("_tm_row").distinct(), "contaminated")
    return rows.join(small_enough(found), "_tm_row", "left_anti").drop("_tm_row").withColumnsRenamed(names)

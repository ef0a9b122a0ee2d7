"""Line dedup by repeated runs of lines.

A run of two or more lines (``MIN_CHARS`` characters besides white space) that
the corpus holds again goes, wherever it starts and ends; its first place in
order of (document, row, position) stays.

1. One pass numbers the rows and cuts chunks that overlap: for each line the
   shortest run from it on, and the shortest run up to it, that is large enough.
   Where a chunk ends depends on its own lines alone, so equal runs are cut
   alike in any surroundings, and every line of a repeated run is in a chunk
   that lies within that run.
2. Chunks are joined with the first place of their 128-bit key, and hits of one
   row that continue each other in the same first row are joined to the longest
   shared run.
3. The lines of the first place travel to the row and are compared byte by byte
   with those that would go.

Counting combines before it shuffles, so a chunk that a third of all rows hold
costs a row per task, and such a chunk is joined where its rows are (see
``join_counted``). Texts that neither lose a line nor hold a first place don't
leave their task; those that do are picked by a broadcast of row numbers, if
these are few enough, and by an exchange otherwise.

Defined results: a null text stays null; a text without a line break is never
changed; a run that overlaps its first place in the same text stays; other
columns of the input are returned as they are, whatever their names. The first
place of a line is never removed.

``dedup_lines`` is the earlier operator: chunks that don't overlap, each equal
to a whole earlier chunk. It misses most short runs and is not registered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import byte_lengths, join_counted, numbered, of_arrays, pieces, shielded, slices, small_enough, staged

WINDOW = 2
DIVISOR = 4
MIN_LINES = 2
MAX_LINES = 64
MIN_CHARS = 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_PRIME = (1 << 127) - 1
_RUN_BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15
_CHUNKS = "array<struct<pos:int,n:int,key:binary>>"


def chunk_bounds(hashes: list[int], window: int = WINDOW, divisor: int = DIVISOR, least: int = MIN_LINES, most: int = MAX_LINES) -> list[tuple[int, int]]:
    """(first line, lines) of each chunk. A chunk ends where the rolling hash of the last ``window`` line hashes says so."""
    power = pow(_BASE, window, 1 << 64)
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h) & _MASK
        if i >= window:
            rolling = (rolling - hashes[i - window] * power) & _MASK
        n = i + 1 - start
        if n >= most or n >= least and (rolling >> 32) % divisor == 0:
            out.append((start, n))
            start = i + 1
    if start < len(hashes):
        out.append((start, len(hashes) - start))
    return out


def _chunks(text: str | None) -> list[dict]:
    if not text or "\n" not in text:
        return []
    lines = text.encode().split(b"\n")
    out = []
    for start, n in chunk_bounds([xxhash.xxh3_64_intdigest(x) for x in lines]):
        chunk = b"\n".join(lines[start : start + n])
        if n >= MIN_LINES and sum(map(len, chunk.split())) >= MIN_CHARS:
            out.append({"pos": start, "n": n, "key": xxhash.xxh3_128_digest(chunk)})
    return out


def line_runs(lines: list[bytes], least: int = MIN_LINES, chars: int = MIN_CHARS) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest large enough run from each line on and up to each line."""
    total = [0]
    for line in lines:
        total.append(total[-1] + sum(map(len, line.split())))
    out, end, start = set(), 0, 0
    for i in range(len(lines)):
        end = max(end, i + least)
        while end <= len(lines) and total[end] - total[i] < chars:
            end += 1
        if end > len(lines):
            break
        out.add((i, end - i))
    for end in range(least, len(lines) + 1):
        while start + 1 <= end - least and total[end] - total[start + 1] >= chars:
            start += 1
        if total[end] - total[start] >= chars:
            out.add((start, end - start))
    return sorted(out)


def _runs(text: str | None, chars: int = MIN_CHARS) -> list[dict]:
    if not text or "\n" not in text:
        return []
    lines = text.encode().split(b"\n")
    # a hash of each beginning of the text gives that of any run, so many short lines cost no more than few long ones
    before, power = [0], [1]
    for line in lines:
        before.append((before[-1] * _RUN_BASE + xxhash.xxh3_128_intdigest(line)) % _PRIME)
        power.append(power[-1] * _RUN_BASE % _PRIME)
    return [{"pos": i, "n": n, "key": ((before[i + n] - before[i] * power[n]) % _PRIME).to_bytes(16, "big")} for i, n in line_runs(lines, chars=chars)]


def _with_lists(docs: DataFrame, of) -> DataFrame:
    """All columns of ``docs``, with ``_tm_row`` and ``_tm_chunks``, the list that ``of`` makes of a text."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("key", pa.binary())]))

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([of(t) for t in batch.slice(lo, hi - lo).to_pylist()], kind) for lo, hi in slices(byte_lengths(batch), 500_000)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return numbered(docs, "_tm_row").withColumn("_tm_chunks", of_arrays(cut, _CHUNKS)("text"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``_tm_row, pos, n, first_row, first_pos``: the longest runs whose keys say that they stand earlier."""
    chunks = rows.select("_tm_row", "doc_id", F.inline("_tm_chunks"))
    # nulls sort last, so that a known document keeps its lines
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_tm_row", "pos")
    first = chunks.groupBy("key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = staged(first.select("key", F.col("_first._tm_row").alias("first_row"), F.col("_first.pos").alias("first_pos"), "_n"), "first-places")
    hits = join_counted(chunks, first, "key", "_n").where((F.col("_tm_row") != F.col("first_row")) | (F.col("first_pos") + F.col("n") <= F.col("pos")))
    lists = hits.groupBy("_tm_row").agg(F.collect_list(F.struct("first_row", "first_pos", "pos", "n")).alias("_hits"))

    def join(batches):
        for batch in batches:
            out = []
            for row, found in zip(batch.column("_tm_row").to_pylist(), batch.column("_hits").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for r, shift, pos, n in sorted((h["first_row"], h["first_pos"] - h["pos"], h["pos"], h["n"]) for h in found):
                    # in the same text a run does not grow into its first place
                    if runs and runs[-1][:2] == [r, shift] and pos <= runs[-1][3] and (r != row or pos + n - runs[-1][2] <= -shift):
                        runs[-1][3] = max(runs[-1][3], pos + n)
                    else:
                        runs.append([r, shift, pos, pos + n])
                out += [(row, pos, end - pos, r, pos + shift) for r, shift, pos, end in runs]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_tm_row", "pos", "n", "first_row", "first_pos"])

    return lists.mapInArrow(join, "_tm_row long, pos int, n int, first_row long, first_pos int")


def _cut(rows: DataFrame) -> DataFrame:
    """``first_row, first_pos, n, lines`` of each run that ``_tm_wanted`` asks for."""

    def cut(batches):
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            out = []
            for row, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("_tm_row", "text", "_tm_wanted")), strict=True):
                lines = text.split("\n")
                out += [(row, w["first_pos"], w["n"], "\n".join(lines[w["first_pos"] : w["first_pos"] + w["n"]])) for w in wanted]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["first_row", "first_pos", "n", "lines"])

    return rows.mapInArrow(cut, "first_row long, first_pos int, n int, lines string")


def _without_runs(rows: DataFrame, counts: bool) -> DataFrame:
    """``rows`` without the lines of ``_tm_hits`` that are equal in bytes to what the hit carries."""
    names = [c for c in rows.columns if c != "_tm_hits"]

    def remove(batches):
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            hits, texts = batch.column("_tm_hits"), batch.column("text")
            out, lost, runs = [], [], []
            for i, found in enumerate(hits.to_pylist()):
                text = texts[i].as_py()
                gone = bytearray()
                if found:
                    lines = text.split("\n")
                    gone = bytearray(len(lines))
                    for h in found:
                        if "\n".join(lines[h["pos"] : h["pos"] + h["n"]]) == h["lines"]:
                            gone[h["pos"] : h["pos"] + h["n"]] = b"\x01" * h["n"]
                    text = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
                out.append(text)
                lost.append(sum(gone))
                runs.append(len(gone.replace(b"\x00", b" ").split()))
            columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            more = [pa.array(lost, pa.int64()), pa.array(runs, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, "removed_lines", "removed_chunks"][: len(names) + len(more)])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(remove, schema + (", removed_lines long, removed_chunks long" if counts else ""))


def dedup_line_runs(docs: DataFrame, counts: bool = True, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated runs; ``counts`` adds ``removed_lines`` and ``removed_chunks`` (runs), or replaces them.

    ``docs`` needs ``doc_id, text``. Runs of fewer than ``min_chars`` characters
    besides white space, such as two closing brackets, stay.
    """
    own, given = shielded(docs.drop("removed_lines", "removed_chunks") if counts else docs)
    rows = staged(_with_lists(own, lambda text: _runs(text, min_chars)), "line-chunks")
    runs = staged(repeated_runs(rows), "line-runs")
    base = rows.drop("_tm_chunks")
    wanted = runs.select(F.col("first_row").alias("_tm_row"), "first_pos", "n").distinct()
    holders = staged(wanted.select("_tm_row").distinct(), "holders")
    wanted = wanted.groupBy("_tm_row").agg(F.collect_list(F.struct("first_pos", "n")).alias("_tm_wanted"))
    first = _cut(base.select("_tm_row", "text").join(small_enough(holders), "_tm_row", "left_semi").join(wanted, "_tm_row"))
    lines = runs.join(first, ["first_row", "first_pos", "n"]).groupBy("_tm_row").agg(F.collect_list(F.struct("pos", "n", "lines")).alias("_tm_hits"))
    hits = staged(lines, "line-hits", runs, holders)
    changed = small_enough(hits.select("_tm_row"))
    cut = _without_runs(base.join(changed, "_tm_row", "left_semi").join(hits, "_tm_row").drop("_tm_row"), counts)
    same = base.join(changed, "_tm_row", "left_anti").drop("_tm_row")
    if counts:
        same = same.withColumns({"removed_lines": F.lit(0).cast("long"), "removed_chunks": F.lit(0).cast("long")})
    return same.unionByName(cut).withColumnsRenamed(given)


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """Occurrences (``_tm_row, pos, n``) that go: equal in bytes to an earlier chunk."""
    chunks = rows.select("_tm_row", "doc_id", F.inline("_tm_chunks"))
    again = chunks.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    found = chunks.join(again, "key", "left_semi")
    lists = found.groupBy("_tm_row").agg(F.collect_list(F.struct("pos", "n")).alias("_found"))
    lines = F.split("text", "\n")
    texts = staged(
        rows.select("_tm_row", "doc_id", "text").join(lists, "_tm_row")
        .select("_tm_row", "doc_id", lines.alias("_lines"), F.inline("_found"))
        .select("_tm_row", "doc_id", "pos", "n", F.array_join(F.slice("_lines", F.col("pos") + 1, F.col("n")), "\n").alias("_bytes")),
        "chunk-texts",
    )
    # nulls sort last, so that a known document keeps its chunk
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_tm_row", "pos")
    first = texts.groupBy("_bytes").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select("_bytes", F.col("_first._tm_row").alias("_kept_row"), F.col("_first.pos").alias("_kept_pos"))
    return (
        texts.join(first, "_bytes")
        .where((F.col("_tm_row") != F.col("_kept_row")) | (F.col("pos") != F.col("_kept_pos")))
        .select("_tm_row", "pos", "n")
    )


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated chunks; ``counts`` adds ``removed_lines`` and ``removed_chunks``, or replaces them.

    ``docs`` needs ``doc_id, text``.
    """
    docs, given = shielded(docs)
    rows = staged(_with_lists(docs, _chunks), "line-chunks")
    gone = repeated_chunks(rows).groupBy("_tm_row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("_tm_gone")
    )
    joined = rows.drop("_tm_chunks").join(gone, "_tm_row", "left")
    # the lines between two removed chunks, from the end of one to the start of the next
    lines = F.split("text", "\n")
    edges = F.concat(
        F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"))), F.col("_tm_gone"), F.array(F.struct(F.size(lines).alias("pos"), F.lit(0).alias("n")))
    )
    left = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(edges) - 1),
            lambda i: F.slice(
                lines,
                F.get(edges, i - 1)["pos"] + F.get(edges, i - 1)["n"] + 1,
                F.get(edges, i)["pos"] - F.get(edges, i - 1)["pos"] - F.get(edges, i - 1)["n"],
            ),
        )
    )
    removed = F.coalesce(F.aggregate("_tm_gone", F.lit(0), lambda a, x: a + x["n"]), F.lit(0))
    text = F.when(F.col("_tm_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")
    added = [
        removed.cast("long").alias("removed_lines"),
        F.when(F.col("_tm_gone").isNull(), 0).otherwise(F.size("_tm_gone")).cast("long").alias("removed_chunks"),
    ]
    names = [c for c in docs.columns if not counts or c not in ("removed_lines", "removed_chunks")]
    return joined.select(*(text if c == "text" else F.col(f"`{c}`") for c in names), *(added if counts else [])).withColumnsRenamed(given)

"""Token ids against the tokenizer itself, the layout against its rules, and the number of sequences against the least possible."""

import zlib
from itertools import accumulate

import numpy as np
import pytest

from tidemill.llm import packing

ODD = [
    "", " ", "\n", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "it's  two   spaces\t\ttab ", " lead and trail ", "naïve façade — 東京タワー 🙂🙂 x",
    "1234567 89,0.5%", "don't can't we'll I'm", " nbsp   em", "a\r\nb\r\n\r\nc", "\x00\x01 ctrl", "é" * 3000, "word " * 5000, "x" * 9000, None,
]


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(4)
    texts = ODD + [" ".join("w%d" % x for x in rng.integers(0, 400, int(n))) for n in rng.integers(1, 900, 120)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "same id", "clash"), (3, "same id", "clash"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(4)
    return rows, packing.pack_documents(docs, with_ids=True).collect()


def test_ids_are_those_of_the_tokenizer(packed):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rows, got = packed
    model = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = []
    for i, text, _ in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or min(1024, len(ids))
        bounds = [0, *accumulate([first] + [1024] * ((len(ids) - first) // 1024))]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4])
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in got]
    assert sorted(found, key=order) == sorted(want, key=order)


def layout(got):
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return used


def test_layout(packed):
    used = layout(packed[1])
    assert len(used) <= 1.05 * sum(r["length"] for r in packed[1]) / 1024


def least(lengths, capacity):
    """Fewest sequences, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i, spaces):
        if len(spaces) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(spaces)
            return
        for s in sorted(set(spaces)):
            if s >= lengths[i]:
                rest = list(spaces)
                rest[rest.index(s)] -= lengths[i]
                put(i + 1, rest)
        put(i + 1, [*spaces, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_plans_against_the_least_possible():
    rng = np.random.default_rng(8)
    over = 0
    for _ in range(60):
        lengths = rng.integers(3, 41, int(rng.integers(1, 10))).tolist()
        histogram = {k: lengths.count(k) for k in set(lengths)}
        runs = packing.packing_plan(histogram, 40, 8)
        placed = sorted(length for length, low, high, _, _ in runs for _ in range(high - low))
        assert placed == sorted(lengths)
        over += len({f + k for _, low, high, f, _ in runs for k in range(high - low)}) - least(lengths, 40)
    assert 0 <= over <= 6


def test_plans_of_many_runs_are_joined_by_bucket(spark, packed, monkeypatch):
    monkeypatch.setattr(packing, "MOST_RUNS", 0)
    docs = spark.createDataFrame([(r[0], r[1]) for r in packed[0]], "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert len(got) == len(packed[1]) and len(layout(got)) == len(layout(packed[1]))
    assert packing.pack_documents(docs.where("false")).count() == 0

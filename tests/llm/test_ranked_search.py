"""Ranked search against scores of every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import ranked_search
from tidemill.llm.queries import ORACLE_SQL

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    texts = [(i, Counter(split(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    rows, total = len(texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in texts:
            m = 25 + 75 * c.total() * rows // total
            score = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, n + 1, None if i == math.inf else i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    words = ["Wort", "été", "ß", "İx", "x1", "A", "data", "of", "the", "a b", "漢字"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(words[int(i)] + [" ", "-", "\n", "\x00", ", "][int(i) % 5] for i in rng.zipf(1.4, n) % len(words))
    docs = [(i, text(int(rng.integers(1, 80)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[7][1]), (400, None), (401, ""), (402, " .,;\n"), (403, text(30_000)), (404, "x" * 300_000)]
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(12)] + [(50, docs[7][1]), (50, docs[7][1]), (51, None), (52, ""), (53, "unheard"), (54, "w1 w1 w1 w2"), (None, "the")]
    return docs, items


def rows(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, tables, monkeypatch, block_bytes):
    docs, items = tables
    monkeypatch.setattr(ranked_search, "SLICE", 900)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, _row long").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    found = ranked_search.search(d, q, block_bytes=block_bytes)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows(found) == brute(docs, items)


def test_bounds_hold_the_score():
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 50, 1000), rng.integers(50, 10**6, 1000)
    exact = ranked_search.impacts(n, tf, 1000, 300_000)
    coarse = -(-exact // ranked_search.STEP)
    assert coarse.max() <= 255 and (coarse * ranked_search.STEP >= exact).all()
    assert (np.where(coarse > 0, (coarse - 1) * ranked_search.STEP + 1, 0) <= exact).all()


def test_slices_of_a_long_text(monkeypatch):
    text = " ".join(f"W{i}" for i in range(500)) + "." + "y" * 300
    monkeypatch.setattr(ranked_search, "TEXT_SLICE", 50)
    assert [t.decode() for run in ranked_search.terms(text.encode()) for t in run] == split(text)


def test_empty_tables(spark, tables):
    docs, items = tables
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.search(d.where("false"), q).collect() == []
    assert ranked_search.search(d, q.where("false")).collect() == []


def test_few_candidates(spark):
    """The upper level leaves little to score exactly."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(j)}" for j in rng.zipf(1.3, 60) % 500)) for i in range(3000)], "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(f"w{j}" for j in range(0, 40, 3)))], "item_id long, text string")
    (block,) = ranked_search.item_blocks(ranked_search.item_terms(items), 1 << 20)
    lower = ranked_search.postings(docs, block.vocabulary).cache()
    total = lower.groupBy().sum("n").first()[0]
    weights = [np.full(len(block.terms[0]), 1000)]
    shared = spark.sparkContext.broadcast((block, weights))
    upper = ranked_search.quantised(lower, 3000, total).cache()
    assert 10 <= ranked_search.candidates(upper, shared, ranked_search.thresholds(upper, shared, 10)).count() < 60


def test_has_sql():
    assert "op12_two_level_search" in ORACLE_SQL

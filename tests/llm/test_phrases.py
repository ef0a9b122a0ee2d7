"""Phrases against counts of every run of words."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, support, limit, most_words=5):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        f = {p: a for p, a in f.items() if a >= support}
        covered = {}
        for p, a in f.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        covered[p[i:j]] = max(covered.get(p[i:j], 0), a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and covered.get(p, 0) < a:
                score, k = min((int(Fraction(1000 * a * n[lang], f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:limit])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["The", "of", "état", "x1", "漢字", "a\x00b", "w\xa0v", "'s", "-"] + [f"w{i}" for i in range(12)]
    seps = [" ", "  ", "\t", ". ", ",", "\n", "!", "\x0b", "\r\n", " ; "]
    text = lambda n: "".join(words[int(i)] + seps[int(j)] for i, j in zip(rng.zipf(1.5, n) % len(words), rng.choice(10, n, p=[0.5, 0.1, 0.1] + [0.3 / 7] * 7), strict=True))
    out = [(["en", "de", None, ""][i % 4], text(int(rng.integers(1, 120)))) for i in range(80)]
    out += [("en", "New York City is big")] * 30 + [("en", None), (None, None), ("fr", ""), ("fr", " \t.\n"), ("en", "x" * 100_000), ("de", text(20_000)), ("de", "one two three four five six " * 2000)]
    return out


def as_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("bits", "slice_", "limit"), [(None, 2_000_000, 2000), (10, 700, 7), (16, 60, 2000)])
def test_against_brute_force(spark, rows, monkeypatch, bits, slice_, limit):
    monkeypatch.setattr(phrases, "SLICE", slice_)
    monkeypatch.setattr(phrases, "MOST_COUNTS", 50)
    docs = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n long").repartition(3)
    found = phrases.collocations(docs, support=20, limit=limit, bits=bits)
    assert [t for _, t in found.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    assert as_rows(found) == brute(rows, 20, limit)


def test_slices_count_each_phrase_once(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 40)
    text = " ".join(f"w{i % 7}" for i in range(300)) + "\n" + "y" * 90 + " z"
    batch = pa.record_batch({"lang": ["en"], "text": pa.array([text.encode()], pa.binary())})
    for k in (1, 2, 5):
        found = Counter(p for _, w in phrases.buffers(batch) for p in [tuple(w.data.split()[i : i + k]) for i in np.flatnonzero(w.together(k))])
        whole = phrases.Words.of(text.encode(), "en")
        assert found == Counter(tuple(text.encode().split()[i : i + k]) for i in np.flatnonzero(whole.together(k)))


def test_pruning_leaves_little(spark):
    """What is counted exactly is near what is frequent, and the corpus is trimmed."""
    rng = np.random.default_rng(2)
    rows = [("en", " ".join(f"v{i}" for i in rng.integers(0, 5000, 200)) + " the white house said " * 2) for _ in range(100)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    texts = docs.selectExpr("lang", "CAST(text AS BINARY) AS text")
    counted = phrases.first_pass(texts, 16, 100).cache()
    words = counted.where("segment IS NULL").groupBy("lang", "phrase").sum("n").where("`sum(n)` >= 100")
    share = spark.sparkContext.broadcast
    known, pairs = share(phrases.bitmap(phrases.of_frequent(words, 1, 16, 100), 16, 100)), share(phrases.bitmap(counted, 16, 100))
    left = phrases.trimmed(texts, known, pairs).selectExpr("sum(octet_length(text))").first()[0]
    assert left < 0.15 * texts.selectExpr("sum(octet_length(text))").first()[0]


def test_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert phrases.collocations(docs.where("false")).collect() == []
    assert phrases.collocations(docs, support=10**6).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(docs, most_words=6)

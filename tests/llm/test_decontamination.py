"""Decontamination against a brute force over all diagonals, on either route, and the masks against all substitutions."""

import re
from itertools import combinations

import numpy as np
import pytest

from tidemill.llm import decontamination as d


def words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n)]


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, items):
    out = set()
    for i, text in texts:
        t = split(text)
        for k, item in items:
            m = split(item)
            if not m:
                continue
            if len(m) < d._LONGEST:
                hit = t == m or len(m) >= d.SHORTEST and any(t[j : j + len(m)] == m for j in range(len(t)))
            else:
                w = min(d.WINDOW, len(m))
                hit = False
                for diagonal in range(-len(m) + 1, len(t)):
                    same = [0 <= j + diagonal < len(t) and t[j + diagonal] == x for j, x in enumerate(m)]
                    hit = hit or any(sum(same[s : s + w]) >= np.ceil(w * d.AGREE) and s + diagonal >= 0 and s + w + diagonal <= len(t) for s in range(len(m) - w + 1))
            if hit:
                out.add((i, k))
    return out


@pytest.mark.parametrize("most", [d.MOST_BROADCAST, 0])
def test_against_brute_force(spark, most):
    rng = np.random.default_rng(9)
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 17, 30, 60]
    items = [(k, " ".join(words(50 + k, n))) for k, n in enumerate(sizes)]
    items += [(90, items[13][1]), (91, items[4][1].upper()), (92, None), (93, ""), (94, "... !")]
    texts = [(0, None), (1, ""), (2, items[0][1]), (3, " ".join(words(1, 40)))]
    for i in range(120):
        body = split(items[int(rng.integers(0, 14))][1])
        at = int(rng.integers(0, max(1, len(body) - 20)))
        body = body[at : at + int(rng.integers(1, 40))]
        for j in rng.choice(len(body), min(len(body), int(rng.integers(0, 3))), replace=False):
            body[j] = f"other{i}x{j}"
        texts.append((100 + i, " ".join(words(1000 + i, int(rng.integers(0, 30))) + body + words(2000 + i, int(rng.integers(0, 30))))))
    texts += [(500, " ".join([items[12][1]] * 40 + words(3, 3000))), (501, items[12][1]), (501, items[12][1])]
    docs = spark.createDataFrame([(*t, "mine") for t in texts], "doc_id long, text string, _tm_row string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    got = d.contamination(docs, benchmark, most).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert sum((r["doc_id"], r["item_id"]) == (501, 12) for r in got) == 2
    kept = d.decontaminate(docs, benchmark, most)
    assert kept.columns == docs.columns and {r["_tm_row"] for r in kept.collect()} == {"mine"}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in texts if i not in {a for a, _ in want})


def test_masks_meet_substitutions():
    lost = {}
    for wrong in (1, 2, 3):
        lost[wrong] = sum(
            not any(all(i + p not in spoiled for p in mask) for mask in d.MASKS for i in range(d.WINDOW - mask[-1])) for spoiled in combinations(range(d.WINDOW), wrong)
        )
    assert lost[1] == lost[2] == 0 and lost[3] <= 7

"""Classes against all pairs of texts, also where a bucket's first text is unlike the rest, and the rows that every operator has to bear."""

import numpy as np

from tidemill.llm import bagminhash
from tidemill.llm.shingles import multiset, weighted_jaccard


def words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n)]


def brute(texts):
    bags = [multiset(t) for t in texts]
    return {(j, i) for i in range(len(texts)) for j in range(i) if weighted_jaccard(bags[i], bags[j]) >= bagminhash.THRESHOLD}


def test_recall_against_all_pairs(spark, monkeypatch):
    """Families around a shared passage, so that unlike texts meet in buckets of many members; small crowds, so that buckets are split."""
    monkeypatch.setattr(bagminhash, "CROWD", 4)
    rng = np.random.default_rng(6)
    common, texts = words(1, 120), []
    for family in range(40):
        own = words(100 + family, 120)
        for _ in range(int(rng.integers(1, 6))):
            body = list(common + own)
            for i in rng.choice(len(body), int(rng.integers(0, 5)), replace=False):
                body[i] = f"z{rng.integers(1 << 30)}"
            texts.append(" ".join(body + ["tail"] * int(rng.integers(0, 3))))
    pairs = brute(texts)
    rows = [(int(k), texts[k], "mine") for k in rng.permutation(len(texts))]
    classes = {}
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string, _tm_row string").repartition(parts)
        classes[parts] = {r["doc_id"]: r["class_id"] for r in bagminhash.duplicate_classes(df).collect()}
        met = sum(classes[parts][a] == classes[parts][b] for a, b in pairs)
        assert len(pairs) > 40 and met >= 0.97 * len(pairs), (met, len(pairs))
    kept = bagminhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r["_tm_row"] for r in kept.collect()} == {"mine"} and kept.count() == len(set(classes[6].values()))


def test_rows_without_words_ids_and_tables(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one two", "d"), (5, "One  two", "e"), (None, "one two", "f"), (6, "x" * 300_000, "g"), (6, "x" * 300_000, "g"), (7, "w " * 40_000, "h"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in bagminhash.near_duplicates(docs).collect()), key=repr)
    want = [(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 3, True), (5, 4, 3, False), (None, 4, 3, False), (6, 6, 2, True), (6, 6, 2, False), (7, 7, 1, True), (None, None, 1, True)]
    assert got == sorted(want, key=repr)
    assert bagminhash.duplicate_classes(docs.where("false")).count() == 0


def test_sketches_pass_pairs_at_the_threshold(spark):
    """Nearly all pairs of 0.8 pass, in the JVM as in tasks, and few of 0.4 do."""
    rng = np.random.default_rng(12)
    passed = {}
    for shared in (800, 400):
        bags = []
        for _ in range(300):
            hashes = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            ones, rest = hashes[:shared], hashes[shared:]
            bags += [(np.sort(np.concatenate([ones, part])), np.ones(shared + len(part), int)) for part in np.array_split(rest, 2)]
        made = bagminhash.sketches(bagminhash.signatures(bags)).tolist()
        rows = [(1000, made[2 * i], 1000, made[2 * i + 1]) for i in range(300)]
        df = spark.createDataFrame(rows, "m long, p array<long>, n long, q array<long>")
        passed[shared] = df.where(bagminhash._may_be_near(("m", "p"), ("n", "q"), 0.8)).count()
    assert passed[800] >= 297 and passed[400] <= 15, passed
    assert df.where(bagminhash._may_be_near(("m", "p"), ("n", "p"), 0.8)).count() == 300


def test_members_of_a_large_bucket_all_meet(spark, monkeypatch):
    """One bucket of 400 unlike texts, of which some are alike in twos that stand far apart by size and number; chunks are smaller than the bucket."""
    for name, value in (("CROWD", 4), ("CHUNK", 90), ("TILE", 3000)):
        monkeypatch.setattr(bagminhash, name, value)
    rng = np.random.default_rng(21)
    sketch = rng.integers(-(1 << 63), 1 << 63, (400, 4))
    sketch[200:] = sketch[:200]
    rows = [(k, int(1000 + k * 200 // 400), sketch[k].tolist(), 0, 77) for k in range(400)]
    members = spark.createDataFrame(rows, "node long, size long, sketch array<long>, band int, bucket long")
    # 0 to 4 and 200 to 204 are one component; 10 and 210 were tried before
    found = spark.createDataFrame([(k, 0) for k in [*range(5), *range(200, 205)]], "node long, component long")
    tried = spark.createDataFrame([(210, 10)], "a long, b long")
    want = {(200 + k, k) for k in range(5, 200) if k != 10}
    for closest in (True, False):
        assert {tuple(r) for r in bagminhash._second_look(members, found, tried, 0.8, closest).collect()} == want
    # two components of near copies: the closest partners first, then every pair between them
    groups = spark.createDataFrame([(k, 1000, [0, 0, 0, (1 << (k % 7)) - 1], k // 30, 5, 60) for k in range(60)], "node long, size long, sketch array<long>, component long, bucket long, _n long")
    assert bagminhash._crowds(groups, 0.8, False).distinct().count() == 900
    monkeypatch.setattr(bagminhash, "CHUNK", 16_384)
    pairs = bagminhash._crowds(groups, 0.8, True).collect()
    assert 30 <= len(pairs) <= 120 and all(r["a"] >= 30 > r["b"] and r["a"] % 7 == r["b"] % 7 for r in pairs)


def test_links_of_a_crowd_are_fewer_than_its_texts(spark, monkeypatch):
    """A bucket of 90 texts in components that a link holds between, or almost does; chunks are smaller than the bucket, so that tasks meet."""
    for name, value in (("CROWD", 4), ("CHUNK", 40), ("TILE", 700), ("CHUNK_SHINGLES", 6000)):
        monkeypatch.setattr(bagminhash, name, value)
    rng, texts = np.random.default_rng(5), []
    for family in range(3):
        body = words(family, 200)
        for k in range(30):
            text = list(body)
            for i in rng.choice(200, int(rng.integers(0, 6)), replace=False):
                text[i] = f"z{rng.integers(1 << 30)}"
            texts.append(" ".join(text + ["tail"] * (k % 3)))
    pairs = brute(texts)
    rows = [(k, len(t.split()) - 4, [0] * 4, k % 7, 5, k) for k, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "node long, size long, sketch array<long>, band int, bucket long, doc_id long")
    found = spark.createDataFrame([(k, k // 30 * 30 + k % 2) for k in range(0, 90, 3)], "node long, component long")
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    tried = spark.createDataFrame([], "a long, b long")
    got = {tuple(r) for r in bagminhash._second_look(members.drop("doc_id"), found, tried, 0.8, True, table).collect()}
    assert 0 < len(got) < 5 * 90 < len(pairs) and all((b, a) in pairs for a, b in got)
    label = list(range(90))
    known = [(k, k // 30 * 30 + k % 2) for k in range(0, 90, 3)]
    joined = lambda links: [label.__setitem__(slice(None), [label[a] if x == label[b] else x for x in label]) for a, b in links] and label.copy()
    mine = joined([*known, *got])
    assert joined(pairs) == mine and 3 <= len(set(mine)) < 20

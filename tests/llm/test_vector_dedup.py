"""Links of vectors against the cosine of every pair."""

import numpy as np
import pytest

from tidemill.llm import vector_dedup


def brute(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in good}:
        some = [i for i in good if len(rows[i][1]) == d]
        m = np.array([rows[i][1] for i in some], np.float64)
        m /= np.abs(m).max(axis=1)[:, None]  # squares of the largest overflow
        m /= np.linalg.norm(m, axis=1)[:, None]
        for a, b in zip(*np.nonzero(m @ m.T >= threshold), strict=True):
            if a != b:
                links[some[a]].add(some[b])
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    f = lambda v: [float(x) for x in np.asarray(v, np.float32)]
    rows = [(i, f(rng.standard_normal(64))) for i in range(300)]
    n = 1000
    for size, noise in [(250, 0.08), (120, 0.22), (60, 0.3), (40, 0.0)] + [(3, 0.31)] * 30:  # cosines about the threshold in the middle ones
        centre = rng.standard_normal(64)
        rows += [(n + i, f(centre + noise * rng.standard_normal(64))) for i in range(size)]
        n += size
    chain = rng.standard_normal(64)
    for i in range(40):  # each link is near, the ends are not
        chain = chain + 0.25 * rng.standard_normal(64)
        rows.append((5000 - i, f(chain)))
    rows += [(1, rows[1][1]), (None, rows[2][1]), (None, f(rng.standard_normal(64))), (7000, None), (7001, []), (7002, [0.0] * 64), (7003, [float("nan")] * 64)]
    rows += [(7004, [1.0, None] + [0.0] * 62), (7005, [float("inf")] + [1.0] * 63), (7006, f(2 * np.array(rows[3][1]))), (7007, [1.0, 2.0]), (7008, [2.0, 4.0]), (7009, [-1.0, -2.0]), (7010, [1e-40, 0.0]), (7011, [1.0, -0.0]), (7012, [1.0, 0.0])]
    return rows


def as_rows(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, vectors, monkeypatch, small):
    if small:  # many cells, chunks and cores
        monkeypatch.setattr(vector_dedup, "CELL_ROWS", 40)
        monkeypatch.setattr(vector_dedup, "CHUNK", 50)
        monkeypatch.setattr(vector_dedup, "CORE_ROWS", 1)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, _row string").repartition(3)
    found = vector_dedup.linked_vectors(df)
    assert found.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    want = brute(vectors)
    assert sum(r[1] > 0 for r in want) > 400
    assert as_rows(found) == want


def test_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(rng.standard_normal((20, 10)), 3, axis=0) + 0.1 * rng.standard_normal((60, 10)))]
    rows += [(100, [1e300, 1e300]), (101, [2e300, 2e300]), (102, [1e-300, 1e-300])]
    assert as_rows(vector_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_cores_and_cells_lose_nothing(vectors):
    """Every pair within a block's distance meets in a cell, and a core's vectors are all linked."""
    unit = vector_dedup.units([np.array(v, np.float32).tobytes() for _, v in vectors[:900] if v], "f4")
    index = vector_dedup.Index(unit, 100 * vector_dedup.CELL_ROWS, 0.95)
    core = index.cores(unit)
    for g in set(core[core >= 0]):
        assert (unit[core == g] @ unit[core == g].T >= 0.95).all()
    assert (core >= 0).sum() >= 200
    placed = vector_dedup.rotated(unit)
    for b, cut in enumerate(vector_dedup.blocks(64)):
        parts = list(index.cells(placed, b))
        home, seen = parts[0][1], {(int(r), int(c)) for rows, cells in parts for r, c in zip(rows, cells, strict=True)}
        assert len(set(home.tolist())) > 20
        for i, j in zip(*np.nonzero(((placed[:, None, cut] - placed[None, :, cut]) ** 2).sum(2) <= index.budget[b]), strict=True):
            assert home[i] > home[j] or (int(j), int(home[i])) in seen


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.linked_vectors(df).collect() == []
    with pytest.raises(ValueError):
        vector_dedup.linked_vectors(df, 0)

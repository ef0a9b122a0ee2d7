"""Line dedup against a brute force over all runs of lines."""

import numpy as np

from tidemill.llm import line_dedup
from tidemill.llm.queries import op4_line_chunk_dedup


def brute(texts):
    """Lines left in each text: a line goes if a run with it (2+ lines, 20+ characters besides white space) stands earlier without overlap."""
    split = [t.split("\n") for t in texts]
    first = {}
    for d, lines in enumerate(split):
        for i in range(len(lines)):
            for j in range(i + 2, len(lines) + 1):
                first.setdefault(tuple(lines[i:j]), (d, i))
    out = []
    for d, lines in enumerate(split):
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 2, len(lines) + 1):
                at, start = first[tuple(lines[i:j])]
                if len("".join("".join(lines[i:j]).split())) >= 20 and (at < d or start + j - i <= i):
                    gone |= set(range(i, j))
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_every_repeated_run_goes(spark, tmp_path):
    rng = np.random.default_rng(11)
    common = ["", "}", "  ", "a b", "short line", "exactly twenty chars xx", "é ü long enough line number one", "another quite long line of text", "----------", "x" * 30]
    texts = ["same line of text here\n" * 5, "\n" * 300 + "end of blanks, long enough"]
    for d in range(120):
        lines = []
        for k in range(rng.integers(1, 6)):
            lines += [f"text of document {d} alone, line {k} {rng.integers(1 << 30)}"] * rng.integers(0, 3)
            lines += [common[i] for i in rng.integers(0, len(common), rng.integers(1, 5))]
        texts.append("\n".join(lines))
    want = brute(texts[:1] + texts[2:])
    rows = spark.createDataFrame(list(enumerate(texts[:1] + texts[2:])) + [(None, None)], "doc_id long, text string").repartition(3)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op4_line_chunk_dedup(spark, str(tmp_path)).collect()}
    assert [got[i]["text"] for i in range(len(want))] == want and got[None]["text"] is None
    lines = lambda t: t.count("\n") + 1
    assert all(got[i]["removed_lines"] == lines(t) - (lines(want[i]) if want[i] else 0) or want[i] == "" for i, t in enumerate(texts[:1] + texts[2:]))
    assert len(line_dedup.line_runs(texts[1].encode().split(b"\n"))) <= 2 * 301


def test_a_run_of_two_lines_goes_in_any_surroundings(spark):
    pair = "first line that many texts share\nsecond line that many texts share"
    rows = [(i, f"own line {i} before the shared one\n{pair}\nown line {i} behind the shared one") for i in range(40)]
    got = line_dedup.dedup_line_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["removed_lines"], r["removed_chunks"]) for r in got} == {i: (2, 1) if i else (0, 0) for i in range(40)}

"""Containment of hundreds of long notices against a plain count over all pairs."""

import re

import numpy as np
import pytest

from tidemill.llm import license_scan


@pytest.mark.parametrize("most", [license_scan.MOST_PREFIXES, 0])
def test_many_templates_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(license_scan, "MOST_PREFIXES", most)
    rng = np.random.default_rng(2)
    common = [f"c{i}" for i in range(200)]
    notice = lambda k: [f"w{k}x{i}" for i in range(int(rng.integers(1, 60)))] + rng.choice(common, int(rng.integers(0, 60))).tolist()
    templates = {f"t{k}": " ".join(notice(k)) for k in range(300)} | {"same": "", "again": " ".join(common[:30])}
    texts = [None, "", "\n\n", " ".join(common) * 3]
    for i in range(200):
        blocks = []
        for k in rng.integers(0, 300, int(rng.integers(1, 4))):
            words = templates[f"t{k}"].split()
            keep = rng.random(len(words)) < rng.choice([0.7, 0.8, 0.9, 1.0])
            words = [w.upper() for w, x in zip(words, keep) if x] + rng.choice(common, 20).tolist()
            blocks.append(", ".join(rng.permutation(words)))
        texts.append("\n \t\n".join(blocks))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(5)
    got = {r["doc_id"]: {m["label"]: m["share"] for m in r["matches"]} for r in license_scan.scan_licenses(docs, templates).collect()}
    sets = {label: set(t.split()) for label, t in templates.items()}
    for i, t in enumerate(texts):
        blocks = [set(re.findall(r"[a-z0-9]+", b.lower())) for b in re.split(r"\n[ \t\r]*\n", t or "")]
        want = {label: max(len(s & b) for b in blocks) / len(s) for label, s in sets.items() if s}
        want = {label: share for label, share in want.items() if share >= license_scan.THRESHOLD - 1e-9}
        assert got[i] == pytest.approx(want), i
    assert license_scan.scan_licenses(docs.where("false"), templates).count() == 0

"""Ownership of private keys is counted per key, not per kind of key."""

import base64
import random

from tidemill.llm import secret_scan


def pem(seed, kind="RSA ", end=True, line="\n"):
    raw = base64.b64encode(random.Random(seed).randbytes(300)).decode()
    lines = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    return line.join([f"-----BEGIN {kind}PRIVATE KEY-----", *lines] + ([f"-----END {kind}PRIVATE KEY-----"] if end else []))


def test_keys_of_one_kind_are_told_apart(spark):
    rows = [(i, f"config\n{pem(i)}\ntail", f"s{i}") for i in range(5)]
    rows += [(10 + i, f"a {pem(99, line=('|n', '\n', '\n    ')[i].replace('|n', chr(92) + 'n'))} b", f"s{i}") for i in range(3)]
    rows += [(20, pem(50, end=False) + "\n\nprose goes on here", "s1"), (21, "-----BEGIN PRIVATE KEY----- is how a key starts", "s1"), (22, pem(60) + "\n" + pem(61), "s2")]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    armour = {r["doc_id"]: [s for s in r["found"] if s["kind"] == "armour"] for r in got}
    assert [armour[i][0]["verdict"] for i in range(5)] == ["live"] * 5
    assert {armour[10 + i][0]["verdict"] for i in range(3)} == {"example"}
    assert [s["verdict"] for s in armour[20] + armour[21] + armour[22]] == ["live", "other", "live", "live"]
    texts = {i: t for i, t, _ in rows}
    assert texts[0][armour[0][0]["start"] : armour[0][0]["end"]] == pem(0)
    assert texts[20][armour[20][0]["start"] : armour[20][0]["end"]] == pem(50, end=False)
    assert [texts[22][s["start"] : s["end"]] for s in armour[22]] == [pem(60), pem(61)]

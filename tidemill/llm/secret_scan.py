"""Secret scan with corpus-wide ownership frequency.

Patterns propose candidates in whole texts. The hash of each candidate's
value is counted over the corpus by distinct repositories and owners: a value
that many owners hold is a copied example; one that a single owner holds, in
few of its repositories, and that looks random is a live-looking credential;
one that a single owner spreads over many repositories is its template.

1. One pass finds the spans and hashes the values; only those are written.
2. (hash, repository, owner) is made distinct and counted per hash; both
   steps combine before they shuffle, so a copied value costs a row per task.
3. The counts are joined with the candidates by hash. Adaptive execution
   splits the hash that a third of all rows hold, since the exchange by row
   that follows has another key.

Defined results: a null text counts as empty; null repositories and owners
are one unknown value each; a private key is its type and body, and an opening
line without a body is never live; repeated rows are scanned one by one; other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import numbered, spans_text, staged

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Formats that the base kinds don't name: platform tokens, signed web tokens, keys in armour.
METHOD = (
    ("platform", re.compile(r"\b(?:gh[opsur]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})", re.ASCII)),
    ("webtoken", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII)),
    ("armour", re.compile(r"-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----")),
)
#: What follows the opening line of a key: up to its END line, else its base64 lines.
_END = re.compile(r"-----END (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----")
_BODY = re.compile(r"""(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{40,}+={0,2})*+(?:(?:\r?\n[ \t]*+|\\n)[A-Za-z0-9+/]++={0,2}(?=[ \t]*+(?:\r?\n|\\[nr]|["']|$)))?""")
_BREAK = re.compile(r"\s|\\[nr]")
KINDS = ("assign", "access", "hex", *(name for name, _ in METHOD))

EXAMPLE_OWNERS = 3
#: Repositories of one owner from which on a value is a template of that owner.
TEMPLATE_REPOSITORIES = 5
LIVE_ENTROPY = 3.0

_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.binary()), ("entropy", pa.float64())])
_SPANS = "array<struct<start:long,rank:int,end:long,kind:string,hash:binary,entropy:double>>"


def _entropy(value: str) -> float:
    n = len(value)
    return -sum((c / n * math.log2(c / n) for c in Counter(value).values()), 0.0)


def _keys(text: str, pattern: re.Pattern) -> list[tuple[int, int, str, str]]:
    """(start, end, value, body) of keys in armour. The value is the opening line and the body, without line breaks, however these are written."""
    opened = list(pattern.finditer(text)) if "-----BEGIN " in text else []
    limits = [x.start() for x in opened[1:]] + [len(text)]
    out = []
    for m, limit in zip(opened, limits, strict=False):
        if closed := _END.search(text, m.end(), limit):
            end, last = closed.end(), closed.start()
        else:
            end = last = _BODY.match(text, m.end(), limit).end()
        body = _BREAK.sub("", text[m.end() : last])
        out.append((m.start(), end, m.group() + body, body))
    return out


def find_secrets(text: str | None) -> list[dict]:
    """Spans of every kind by start, then kind; offsets are code points."""
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    bodies = {}
    for rank, (name, pattern) in enumerate(METHOD, 3):
        if name == "armour":
            for start, end, value, body in _keys(text, pattern):
                found.append((start, rank, end, value))
                bodies[start, rank] = body
        else:
            found += [(m.start(), rank, m.end(), m.group()) for m in pattern.finditer(text)]
    return [
        {"start": s, "rank": r, "end": e, "kind": KINDS[r], "hash": hashlib.sha256(v.encode()).digest()[:16], "entropy": _entropy(bodies.get((s, r), v))}
        for s, r, e, v in sorted(found)
    ]


def _candidates(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    rows = numbered(docs.select(F.col("doc_id").cast("long"), F.col(f"`{repository}`").alias("repository"), F.col(f"`{owner}`").alias("owner"), "text"), "_row")

    def scan(batches):
        for batch in batches:
            spans = pa.array([find_secrets(t) for t in batch.column("text").to_pylist()], pa.list_(_SPAN))
            names = ["_row", "doc_id", "repository", "owner"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), spans], [*names, "spans"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(scan, f"_row long, doc_id long, repository {kinds['repository']}, owner {kinds['owner']}, spans {_SPANS}")


def ownership_frequency(found: DataFrame) -> DataFrame:
    """``hash, n_repositories, n_owners`` over all candidates."""
    values = found.select("repository", "owner", F.explode("spans.hash").alias("hash")).groupBy("hash", "repository", "owner").agg(F.lit(1).alias("_one"))
    # Pairs are distinct, so repositories and owners of a hash are counted from sub-totals.
    repositories = values.groupBy("hash", "repository").agg(F.lit(1).alias("r")).groupBy("hash").agg(F.sum("r").alias("n_repositories"))
    owners = values.groupBy("hash", "owner").agg(F.lit(1).alias("o")).groupBy("hash").agg(F.sum("o").alias("n_owners"))
    return repositories.join(owners, "hash")


def scan_secrets(
    docs: DataFrame, repository: str = "source", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, template_repositories: int = TEMPLATE_REPOSITORIES, live_entropy: float = LIVE_ENTROPY,
) -> DataFrame:
    """One row per document: ``found``, the spans with counts and ``verdict`` (example, template, live, other)."""
    found = staged(_candidates(docs, repository, owner), "secrets")
    counted = (
        found.where(F.size("spans") > 0).select("_row", F.inline("spans"))
        .join(ownership_frequency(found), "hash")
        .withColumn(
            "verdict",
            F.when(F.col("n_owners") >= example_owners, "example")
            .when((F.col("n_owners") == 1) & (F.col("n_repositories") >= template_repositories), "template")
            .when((F.col("n_owners") == 1) & (F.col("entropy") >= live_entropy), "live").otherwise("other"),
        )
    )
    fields = ("start", "rank", "end", "kind", F.hex("hash").alias("hash"), "entropy", "n_repositories", "n_owners", "verdict")
    lists = counted.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("found"))
    none = F.array().cast(lists.schema["found"].dataType)
    return found.select("_row", "doc_id").join(lists, "_row", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    base = F.filter("found", lambda s: s["rank"] < 3)

    def count(name, key, value):
        return F.size(F.filter("found", lambda s: s[key] == value)).cast("long").alias(name)

    return scanned.select(
        "doc_id",
        count("n_assign", "kind", "assign"),
        count("n_access", "kind", "access"),
        count("n_hex", "kind", "hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
        count("n_live", "verdict", "live"),
        count("n_example", "verdict", "example"),
        F.coalesce(F.array_max("found.n_owners"), F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce(F.array_max("found.n_repositories"), F.lit(0)).cast("long").alias("most_repositories"),
    )

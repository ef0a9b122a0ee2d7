"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.bagminhash import duplicate_classes
from tidemill.llm.compact_windows import near_passages
from tidemill.llm.decontamination import contamination
from tidemill.llm.language_id import identify_languages
from tidemill.llm.license_scan import license_digest, scan_licenses
from tidemill.llm.line_dedup import dedup_line_runs
from tidemill.llm.packing import pack_documents
from tidemill.llm.phrases import collocations
from tidemill.llm.pii import find_pii, pii_digest
from tidemill.llm.quality_rules import quality_features
from tidemill.llm.ranked_search import search
from tidemill.llm.secret_scan import scan_secrets, secret_digest
from tidemill.llm.vector_dedup import linked_vectors

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(read(spark, sf_dir, "documents")))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(read(spark, sf_dir, "documents")))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_line_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_features(read(spark, sf_dir, "documents"))


def op6_license_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(read(spark, sf_dir, "documents")))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(read(spark, sf_dir, "documents"))


def op8_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op11_subspace_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(read(spark, sf_dir, "embeddings"))


def op12_two_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_ownership,
        op2_pii_spans,
        op3_spaced_seed_decontamination,
        op4_line_chunk_dedup,
        op5_quality_fertility,
        op6_license_containment,
        op7_compact_windows,
        op8_bagminhash_classes,
        op9_best_fit_packing,
        op10_language_id,
        op11_subspace_links,
        op12_two_level_search,
        op13_phrase_collocations,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_PIECES = rf"unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]'))"
_FIRST, _REST = "array_to_string(string_split(phrase, ' ')[1:k], ' ')", "array_to_string(string_split(phrase, ' ')[k + 1:], ' ')"

#: The other operators aren't within reach of SQL on whole tables; tests/llm has brute-force versions (see README).
ORACLE_SQL: dict[str, str] = {
    "op11_subspace_links": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(e, e) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    c(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y), m AS (SELECT x, min(y) AS component_id FROM c GROUP BY 1)
    SELECT x AS vec_id, (SELECT count(*) FROM l WHERE l.x = m.x) AS n_links, component_id, x = component_id AS kept FROM m""",
    "op12_two_level_search": f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), s AS (SELECT count(*) AS rows_, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
    i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * rows_ + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
    c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * rows_) // total))) AS worth FROM p JOIN w USING (term), s),
    r AS (SELECT item_id, doc_id, CAST(sum(times * worth) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY 1, 2)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op13_phrase_collocations": rf"""WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, {_PIECES} AS piece FROM documents)),
    s AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
    g AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size),
    f AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
    k AS (SELECT lang, phrase, a, k, {_FIRST} AS first_part, {_REST} AS rest FROM f, (SELECT unnest(range(1, 5)) AS k) WHERE size > k),
    c AS (SELECT k.lang, k.phrase, k.a, k, x.a AS l, y.a AS r, n, CAST((1000 * CAST(k.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = first_part JOIN f y ON y.lang = k.lang AND y.phrase = rest JOIN s ON s.lang = k.lang),
    m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = m.lang AND f.a >= m.a AND f.phrase <> m.phrase AND contains(' ' || f.phrase || ' ', ' ' || m.phrase || ' ')))
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000""",
}

"""Joins of names that are nearly equal, by segments that near names must share.

A score of ``t`` bounds the edits by the longer length: ``d = floor((1 - t) * longer)``.
A name cut into ``d + 1`` segments keeps one of them whole through ``d`` edits,
and that one stands in the value at most so far from its place as the edits
before and behind it allow. So for each pair of lengths that can reach the
score, names offer their segments and values the pieces that may be one; equal
ones meet by an equi-join, and the distance decides. Nothing that reaches the
score is missed.

Names that share most of their text (``Customer#000001``) meet by what they
share. Spark deals such a key out as it does any skewed join, and a pair leaves
its task only if it reaches the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries

QUERIES = Queries()


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, without regard to case; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longer)


def _lengths(own: Column, threshold: float) -> Column:
    """The lengths that can reach the score with a text of this one."""
    return F.sequence(F.ceil(own * threshold - 1e-9).cast("int"), F.floor(own / threshold + 1e-9).cast("int"))


def _segments(df: DataFrame, text: str, threshold: float, offered: bool) -> DataFrame:
    """The rows with ``_a`` and ``_b``, lengths of a value and a name, ``_i`` and ``_s``, the number of a segment and its text."""
    own, other = ("_b", "_a") if offered else ("_a", "_b")
    rows = df.withColumn(own, F.length(text)).withColumn(other, F.explode(_lengths(F.col(own), threshold)))
    rows = rows.withColumn("_d", F.floor(F.greatest("_a", "_b") * (1 - threshold) + 1e-9).cast("int"))
    # a name with no more letters than edits has nothing it must keep: it meets all of the length
    rows = rows.withColumn("_i", F.explode(F.when(F.col("_d") < F.col("_b"), F.sequence(F.lit(0), F.col("_d"))).otherwise(F.array(F.lit(-1)))))
    start = F.floor(F.col("_i") * F.col("_b") / (F.col("_d") + 1)).cast("int")
    size = F.floor((F.col("_i") + 1) * F.col("_b") / (F.col("_d") + 1)).cast("int") - start
    piece = lambda at: F.when(F.col("_i") < 0, F.lit("")).otherwise(F.substr(F.lower(text), at + 1, size))
    if offered:
        return rows.withColumn("_s", piece(start)).drop("_d")
    shift, behind = F.col("_a") - F.col("_b"), F.col("_d") - F.col("_i")
    low = F.greatest(F.lit(0), start - F.col("_i"), start + shift - behind)
    high = F.least(F.col("_a") - size, start + F.col("_i"), start + shift + behind)
    places = F.when(F.col("_i") < 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("_s", F.explode(F.array_distinct(F.transform(places, piece)))).drop("_d")


def candidates(values: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """``value, name`` of pairs that share a segment; some more than once."""
    return _segments(values, "value", threshold, False).join(_segments(names, "name", threshold, True), ["_a", "_b", "_i", "_s"]).select("value", "name")


def near_pairs(values: DataFrame, names: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``value, name, score`` of all pairs of distinct ``value`` and ``name`` that reach the score."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is over 0, 1 at most")
    v, n = (df.select(c).where(F.col(c).isNotNull()).distinct() for df, c in ((values, "value"), (names, "name")))
    scored = candidates(v, n, threshold).withColumn("score", similarity(F.col("value"), F.col("name")))
    return scored.where(F.col("score") >= threshold).distinct()


def best_matches(df: DataFrame, column: str, names: DataFrame, name: str, threshold: float = 0.6) -> DataFrame:
    """``value, name, score``: for each distinct value that has one, the best of ``names``, of equal scores the last in order.

    Values that are a name, but for case, get it by an equi-join and are not
    compared further.
    """
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    known = names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct()
    exact = values.join(known, F.lower("value") == F.lower("name")).groupBy("value").agg(F.max("name").alias("name")).withColumn("score", F.lit(1.0))
    left = values.join(exact.select(F.col("value").alias("_done")), F.col("value") == F.col("_done"), "left_anti")
    best = near_pairs(left, known, threshold).groupBy("value").agg(F.max(F.struct("score", "name")).alias("_best"))
    return exact.unionByName(best.select("value", "_best.name", "_best.score"))


_SCORE = "1 - levenshtein(lower(value), lower(name)) / greatest(length(value), length(name))"


@QUERIES.of(
    "part", "nation",
    sql="""WITH v AS (SELECT DISTINCT substr(p_name, 1, 6) || 'x' AS value FROM part), k AS (SELECT DISTINCT substr(p_name, 1, 6) AS name FROM part UNION SELECT n_name FROM nation),
    s AS (SELECT value, name, 1 - levenshtein(lower(value), lower(name)) / greatest(length(value), length(name)) AS score FROM v CROSS JOIN k)
    SELECT DISTINCT ON (value) value, name, round(score, 6) AS score FROM s WHERE score >= 0.6 ORDER BY value, score DESC, name DESC""",
)
def fuzzy_join(part: DataFrame, nation: DataFrame) -> DataFrame:
    """Each value with the known name that is most like it."""
    known = part.select(F.substring("p_name", 1, 6).alias("name")).union(nation.select("n_name"))
    found = best_matches(part.select(F.concat(F.substring("p_name", 1, 6), F.lit("x")).alias("v")), "v", known, "name")
    return found.withColumn("score", F.round("score", 6))


_WORD = "regexp_extract(lower(text), '^[a-z]{4,}')"


@QUERIES.of(
    "documents", "benchmark",
    sql=f"""WITH v AS (SELECT DISTINCT {_WORD} AS value FROM documents), k AS (SELECT DISTINCT {_WORD} AS name FROM benchmark),
    s AS (SELECT value, name, {_SCORE} AS score FROM v CROSS JOIN k WHERE value <> '' AND name <> '') SELECT value, name, round(score, 6) AS score FROM s WHERE score >= 0.7""",
)
def fuzzy_pairs(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All pairs of first words of documents and of benchmark items that are nearly equal."""
    word = lambda df, name: df.select(F.regexp_extract(F.lower("text"), "^[a-z]{4,}", 0).alias(name)).where(F.col(name) != "")
    return near_pairs(word(documents, "value"), word(benchmark, "name"), 0.7).withColumn("score", F.round("score", 6))

"""Full-text search by an inverted index: a table of postings that a search reads the terms of alone.

The index is a folder of two tables. ``postings`` has a row for each term of a
row: the row's key, how often it has the term, and how many terms it has. Its
files are dealt by a hash of the term into ``BUCKETS`` folders and sorted by
term within, so a search prunes folders by the buckets of its terms, and row
groups by their statistics. A term that very many rows have is dealt by key
within its bucket, so that no task writes it alone. ``totals`` has one row: how
many rows and terms there are.

Scores are BM25 (``k1`` 1.2, ``b`` 0.75), rounded to six places; equal scores go
by key. A term's frequency is counted from the postings that the search reads
anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries, scratch

QUERIES = Queries()
BUCKETS = 64
#: Tasks that write a bucket, at least, and the words of the table for each of them.
PARTS = 4
PART_TERMS = 500_000
K1, B = 1.2, 0.75
WORD = r"[^\p{L}\p{N}]+"


def terms(c: Column) -> Column:
    """The words of a text (letters and digits), lower-cased; none of null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WORD, -1), lambda w: w != "")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(words: Column) -> Column:
    """``term, tf`` of each distinct word of a list: runs of the sorted list."""
    ordered = F.array_sort(words)
    runs = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
    ends = lambda t, first: F.transform(first, lambda i, n: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(first, n + 1), F.size(t)) - i).cast("long").alias("tf")))
    # lists are bound by a transform of one element, so that each is made once
    return F.get(F.transform(F.array(ordered), lambda t: F.get(F.transform(F.array(runs(t)), lambda first: ends(t, first)), 0)), 0)


def build(df: DataFrame, keys: list[str], text: str, path: str) -> None:
    """Index every row of a table, which ``keys`` tell apart, by a text column; whole texts are read, rows without a word have no postings."""
    words = df.select(*keys, terms(F.col(text)).alias("_t")).withColumn("n_terms", F.size("_t")).where("n_terms > 0")
    words.agg(F.count("*").alias("n_rows"), F.sum("n_terms").cast("long").alias("n_terms")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    n = df.sparkSession.read.parquet(f"{path}/totals").first()["n_terms"] or 0  # a single row
    parts = max(PARTS, -(-n // (BUCKETS * PART_TERMS)))
    # words are counted within their row, so only postings are exchanged
    rows = words.select(*keys, "n_terms", F.inline(counted(F.col("_t"))))
    dealt = rows.withColumns({"bucket": bucket_of(F.col("term")), "_part": F.pmod(F.xxhash64(*keys), F.lit(parts))}).repartition(BUCKETS * parts, "bucket", "_part").drop("_part")
    dealt.select("bucket", "term", *keys, "n_terms", "tf").sortWithinPartitions("bucket", "term", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The postings of some terms; only their buckets are read."""
    numbers = [r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(bucket_of(F.col("term"))).distinct().collect()]  # of the query's words
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(numbers) & F.col("term").isin(words)).drop("bucket")


def search(spark: SparkSession, path: str, text: str, keys: list[str], size: int = 20) -> DataFrame:
    """``keys`` and ``score`` of the ``size`` rows that answer a text best; a word that is repeated counts once."""
    words = sorted(set(spark.createDataFrame([(text,)], "t string").select(terms(F.col("t"))).first()[0]))
    found = postings(spark, path, words)
    totals = spark.read.parquet(f"{path}/totals").withColumnsRenamed({"n_rows": "_rows", "n_terms": "_all"})
    frequency = found.groupBy("term").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(totals))  # a row for each word of the query, by a single row
    idf = F.log(1 + (F.col("_rows") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") * F.col("_rows") / F.col("_all")))
    scored = found.join(F.broadcast(frequency), "term").groupBy(*keys).agg(F.round(F.sum(weight), 6).alias("score"))
    return scored.orderBy(F.desc("score"), *keys).limit(size)


def _oracle(table: str, keys: str, words: str) -> str:
    return f"""WITH d AS (SELECT {keys}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ts FROM {table}),
    s AS (SELECT count(*) AS n_rows, sum(len(ts)) AS n_all FROM d WHERE len(ts) > 0),
    p AS (SELECT {keys}, n, term, count(*) AS tf FROM (SELECT {keys}, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN ({words}) GROUP BY ALL),
    f AS (SELECT term, ln(1 + (n_rows - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, n_rows)
    SELECT {keys}, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n * n_rows / n_all))), 6) AS score FROM p JOIN f USING (term), s GROUP BY {keys} ORDER BY score DESC, {keys} LIMIT 20"""


@QUERIES.of("documents", sql=_oracle("documents", "doc_id", "'license', 'the'"))
def search_documents(documents: DataFrame) -> DataFrame:
    """The 20 best documents for two words, one of them in nearly all English texts."""
    path = scratch(documents.sparkSession, "text-index")
    build(documents, ["doc_id"], "text", path)
    return search(documents.sparkSession, path, "The license, the LICENSE", ["doc_id"])


@QUERIES.of("conversations", sql=_oracle("conversations", "conv_id, turn", "'thand', 'the', 'ed', 'ion'"))
def search_conversations(conversations: DataFrame) -> DataFrame:
    """The 20 best turns for four words."""
    path = scratch(conversations.sparkSession, "text-index")
    build(conversations, ["conv_id", "turn"], "text", path)
    return search(conversations.sparkSession, path, "thand the ed ion", ["conv_id", "turn"])

"""Names, distances and escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.fuzzy import similarity
from tidemill.plans.declare import Queries

QUERIES = Queries()


def kebab(c: Column) -> Column:
    return F.lower(F.translate(c, "_", "-"))


def sanitized(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def camel_column(c: Column) -> Column:
    """``order_key`` -> ``orderKey`` for names that are data; underscores in front stay."""
    lead = F.regexp_extract(c, "^_*", 0)
    parts = F.split(F.lower(F.substr(c, F.length(lead) + 1)), "_", -1)
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.concat(lead, F.get(parts, F.lit(0)), F.array_join(rest, ""))


def snake_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, "([A-Z])", "_$1")), "^_", "")


def matches(df: DataFrame, column: str, probe: str, threshold: float = 0.6, most: int = 5) -> DataFrame:
    """``column, score, distance`` of the values most like a probe: one that is equal alone, or else the top by score, then distance.

    A top-k over the distinct values that reach the threshold.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    scored = values.select(column, similarity(F.col(column), F.lit(probe)).alias("score"), F.levenshtein(F.lower(column), F.lit(probe.lower())).alias("distance"))
    same = F.lower(column) == probe.lower()
    top = scored.where(F.col("score") >= threshold).orderBy(F.desc(same), F.desc("score"), "distance", column).limit(most)
    exact = F.max(same).over(Window.partitionBy())  # of these few
    return top.withColumn("_exact", exact).where(~F.col("_exact") | same).drop("_exact")


def did_you_mean(df: DataFrame, column: str, probe: str) -> str:
    """A message with up to three suggestions."""
    found = [r[column] for r in matches(df, column, probe, 0.5, 3).collect()]  # three at most
    return f"{probe!r} isn't known" + (f"; did you mean {', '.join(map(repr, found))}?" if found else "")


def url_masked(c: Column) -> Column:
    return F.regexp_replace(c, r"(://[^:/@]+:)([^@]+)(@)", "$1***$3")


def html_escaped(c: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


@QUERIES.of("part", sql="SELECT p_partkey, lower(replace(p_type, '_', '-')) AS kebab, regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g') AS clean FROM part")
def str_case(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", kebab(F.col("p_type")).alias("kebab"), sanitized(F.col("p_name")).alias("clean"))


@QUERIES.of("part", sql="SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def fuzzy_distance(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@QUERIES.of(
    "nation",
    sql="""SELECT n_name, round(1 - levenshtein(lower(n_name), 'nation_12') / greatest(length(n_name), 9), 6) AS score
    FROM nation WHERE 1 - levenshtein(lower(n_name), 'nation_12') / greatest(length(n_name), 9) >= 0.6 ORDER BY score DESC, n_name LIMIT 5""",
)
def fuzzy_topk(nation: DataFrame) -> DataFrame:
    score = similarity(F.col("n_name"), F.lit("NATION_12"))
    return nation.where(score >= 0.6).select("n_name", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "n_name").limit(5)


@QUERIES.of("customer", sql="SELECT c_custkey, 'postgres://u' || c_custkey || ':***@db.example/x' AS url FROM customer")
def url_mask(customer: DataFrame) -> DataFrame:
    url = F.concat(F.lit("postgres://u"), F.col("c_custkey").cast("string"), F.lit(":s3cr:et@db.example/x"))
    return customer.select("c_custkey", url_masked(url).alias("url"))


@QUERIES.of("pages", sql="""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def html_escape(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.md5(html_escaped(F.col("html"))).alias("escaped"))


@QUERIES.of("nation", sql="SELECT n_name, 1.0 AS score, 0 AS distance FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def fuzzy_exact(nation: DataFrame) -> DataFrame:
    """A probe that is there, in another case: it alone, not its neighbours."""
    probe = nation.agg(F.max("n_name")).first()[0].lower()
    return matches(nation, "n_name", probe)


_BEST = "1 - levenshtein(lower(n_name), 'naton_1') / greatest(length(n_name), 7)"


@QUERIES.of("nation", sql=f"SELECT n_name, round({_BEST}, 6) AS score, CAST(levenshtein(lower(n_name), 'naton_1') AS INTEGER) AS distance FROM nation WHERE {_BEST} >= 0.6 ORDER BY 2 DESC, 3, 1 LIMIT 1")
def fuzzy_best(nation: DataFrame) -> DataFrame:
    return matches(nation, "n_name", "NATON_1", most=1).withColumn("score", F.round("score", 6))


@QUERIES.of("region", sql="SELECT r_regionkey, 'orderKey' || r_regionkey || 'Ab' AS camel, 'order_key' || r_regionkey || '_ab' AS snake FROM region")
def str_camel_snake(region: DataFrame) -> DataFrame:
    name = F.concat(F.lit("order_KEY"), F.col("r_regionkey").cast("string"), F.lit("_AB"))
    camel = camel_column(name)
    return region.select("r_regionkey", camel.alias("camel"), snake_column(camel).alias("snake"))

"""Keys and links that nobody declared, from the data alone: unique columns and pairs, and columns that lie in a key.

Candidates are pruned by one aggregate a table (rows, nulls, estimates of how
many values there are), level by level: a pair is looked at only if neither
column is a key and their numbers of values allow it. What is left is verified
exactly. Links are found for all columns at once: each value carries the set of
columns that have it, and a column lies in another if every set with the one
has the other.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries, written

QUERIES = Queries()
#: Average length of texts that may be keys, and how far estimates may be off.
LONGEST = 64
ERROR = 0.15
_KINDS = {"tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "string": "text"}


def profile(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Column -> (rows, estimated values) of the columns that may be part of a key: whole numbers and short texts, never null."""
    columns = [c for c, kind in df.dtypes if kind in _KINDS]
    if not columns:
        return {}
    parts = [F.struct(F.count(c).alias("n"), F.approx_count_distinct(c, 0.03).alias("v"), F.coalesce(F.avg(F.length(F.col(c).cast("string"))), F.lit(0)).alias("size")).alias(c) for c in columns]
    row = df.agg(F.count("*").alias("_n"), *parts).first()
    return {c: (row["_n"], row[c]["v"]) for c in columns if row["_n"] and row[c]["n"] == row["_n"] and (dict(df.dtypes)[c] != "string" or row[c]["size"] <= LONGEST)}


def is_unique(df: DataFrame, columns: list[str]) -> bool:
    """Whether no two rows agree in all of the columns."""
    return df.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def keys_of(df: DataFrame) -> list[tuple[str, ...]]:
    """The smallest sets of one or two columns that tell all rows apart."""
    known = profile(df)
    near = lambda rows, values: values >= rows * (1 - ERROR)
    single = [(c,) for c, (rows, values) in known.items() if near(rows, values) and is_unique(df, [c])]
    rest = [c for c in known if (c,) not in single]
    pairs = [p for p in combinations(rest, 2) if near(known[p[0]][0], known[p[0]][1] * known[p[1]][1])]
    if not pairs:
        return single
    row = df.agg(*(F.approx_count_distinct(F.struct(*p), 0.03).alias(str(i)) for i, p in enumerate(pairs))).first()
    return single + [p for i, p in enumerate(pairs) if near(known[p[0]][0], row[i]) and is_unique(df, list(p))]


def stem(column: str) -> str:
    """``o_orderkey`` -> ``orderkey``: a name without a table's initials."""
    return re.sub("^[a-z]{1,2}_", "", column)


def inclusions(columns: dict[str, DataFrame], parents: list[str]) -> DataFrame:
    """``child, parent, n_values``: which columns lie in which; ``columns`` are frames of one column by name."""
    values = [df.select(F.col(df.columns[0]).cast("string").alias("value")).where("value IS NOT NULL").distinct().withColumn("name", F.lit(name)) for name, df in columns.items()]
    every = values[0]
    for some in values[1:]:
        every = every.unionByName(some)
    # as many names as there are columns, in a set for each value; then a row for each set
    sets = every.groupBy("value").agg(F.sort_array(F.collect_set("name")).alias("names")).groupBy("names").agg(F.count("*").alias("n"))
    sets = written(sets, "value-sets")
    totals = sets.select(F.explode("names").alias("child"), "n").groupBy("child").agg(F.sum("n").alias("n_values"))
    both = sets.select(F.explode("names").alias("child"), "names", "n").select("child", F.explode("names").alias("parent"), "n")
    both = both.where((F.col("child") != F.col("parent")) & F.col("parent").isin(parents)).groupBy("child", "parent").agg(F.sum("n").alias("_shared"))
    return both.join(totals, "child").where("_shared = n_values").select("child", "parent", "n_values")


def links_of(tables: dict[str, DataFrame], named: bool = True) -> DataFrame:
    """``child, column_name, parent, parent_column, n_values`` of the columns whose values all are in another table's key of one column.

    ``named`` keeps those of like names (but for a table's initials): small
    numbers lie in nearly every key.
    """
    keys = [(t, k[0]) for t, df in tables.items() for k in keys_of(df) if len(k) == 1]
    kind = lambda t, c: _KINDS.get(dict(tables[t].dtypes)[c])
    wanted: dict[str, set[tuple[str, str]]] = {}
    for t, df in tables.items():
        for c, type_ in df.dtypes:
            if type_ in _KINDS and any(p != t and kind(t, c) == kind(p, k) and (not named or stem(c) == stem(k)) for p, k in keys):
                wanted.setdefault(kind(t, c), set()).add((t, c))
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "child string, column_name string, parent string, parent_column string, n_values long")
    for columns in wanted.values():
        both = columns | {(t, k) for t, k in keys if any(not named or stem(c) == stem(k) for _, c in columns)}
        found = inclusions({f"{t}.{c}": tables[t].select(c) for t, c in sorted(both)}, [f"{t}.{k}" for t, k in keys])
        split = lambda c, i: F.substring_index(c, ".", i)
        rows = found.select(split("child", 1).alias("child"), split("child", -1).alias("column_name"), split("parent", 1).alias("parent"), split("parent", -1).alias("parent_column"), "n_values")
        like = F.regexp_replace("column_name", "^[a-z]{1,2}_", "") == F.regexp_replace("parent_column", "^[a-z]{1,2}_", "")
        out = out.unionByName(rows.where((F.col("child") != F.col("parent")) & (like if named else F.lit(True))))
    return out


def read(spark: SparkSession, sf_dir: str, tables) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}


#: The driver's tables and their columns of whole numbers and texts (fixed values), for the oracles.
COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), "events": ("event_id", "user_id", "event_type", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"), "embeddings": ("vec_id", "label"), "pages": ("page_id", "url", "html"), "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"), "conversations": ("conv_id", "turn", "role", "text"),
}


def _fits(*columns: str) -> str:
    return " AND ".join(f"count({c}) = count(*) AND (typeof(any_value({c})) <> 'VARCHAR' OR avg(length(CAST({c} AS VARCHAR))) <= {LONGEST})" for c in columns)


def _key_oracle() -> str:
    out = []
    for t, columns in COLUMNS.items():
        out += [f"SELECT '{t}' AS table_name, '{c}' AS columns FROM {t} HAVING {_fits(c)} AND count(DISTINCT {c}) = count(*)" for c in columns]
        for a, b in combinations(columns, 2):
            out.append(f"SELECT '{t}', '{a},{b}' FROM {t} HAVING {_fits(a, b)} AND count(DISTINCT {a}) < count(*) AND count(DISTINCT {b}) < count(*) AND count(DISTINCT ({a}, {b})) = count(*)")
    return " UNION ALL ".join(out)


def _link_oracle(tables: tuple[str, ...] = tuple(COLUMNS)) -> str:
    out = []
    for t, columns in ((t, COLUMNS[t]) for t in tables):
        for p, keys in ((t, COLUMNS[t]) for t in tables):
            for c in columns:
                for k in keys:
                    if p != t and stem(c) == stem(k) and c not in ("text", "html"):
                        unique = f"(SELECT count(DISTINCT {k}) = count(*) AND (typeof(any_value({k})) <> 'VARCHAR' OR avg(length(CAST({k} AS VARCHAR))) <= {LONGEST}) FROM {p})"
                        out.append(f"SELECT '{t}' AS child, '{c}' AS column_name, '{p}' AS parent, '{k}' AS parent_column, count(DISTINCT {c}) AS n_values FROM {t} HAVING count({c}) > 0 AND {unique} AND NOT EXISTS (SELECT {c} FROM {t} WHERE {c} IS NOT NULL EXCEPT SELECT {k} FROM {p})")
    return " UNION ALL ".join(out)


def found_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all tables, one or two columns each."""
    rows = [(t, ",".join(k)) for t, df in read(spark, sf_dir, COLUMNS).items() for k in keys_of(df)]
    return spark.createDataFrame(rows, "table_name string, columns string")


def link_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links to customers and orders by the data: how many rows a parent has at most, how many parents have none, and what that makes the link."""
    tables = read(spark, sf_dir, ("customer", "orders", "lineitem", "documents", "labels"))
    out = []
    for r in links_of(tables).collect():  # a row for each link
        children = tables[r["child"]].groupBy(F.col(r["column_name"]).alias("_k")).agg(F.count("*").alias("_n"))
        joined = tables[r["parent"]].select(r["parent_column"]).join(children, F.col(r["parent_column"]) == F.col("_k"), "left")
        kind = F.when(F.max("_n") > 1, "many-to-one").otherwise("one-to-one").alias("cardinality")
        out.append(joined.agg(F.max("_n").alias("most"), F.count_if(F.col("_k").isNull()).alias("n_without"), kind).select(F.lit(r["child"]).alias("child"), F.lit(r["parent"]).alias("parent"), "cardinality", "most", "n_without"))
    every = out[0]
    for some in out[1:]:
        every = every.unionByName(some)
    return every


def _cardinality(child: str, column: str, parent: str, key: str) -> str:
    return f"SELECT '{child}' AS child, '{parent}' AS parent, CASE WHEN max(n) > 1 THEN 'many-to-one' ELSE 'one-to-one' END AS cardinality, max(n) AS most, count(*) FILTER (n IS NULL) AS n_without FROM {parent} LEFT JOIN (SELECT {column} AS k, count(*) AS n FROM {child} GROUP BY 1) ON k = {parent}.{key}"


def found_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between all tables."""
    return links_of(read(spark, sf_dir, COLUMNS))


def tables_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables, the largest first, with their share of all rows."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in read(spark, sf_dir, COLUMNS).items()]
    every = counts[0]
    for some in counts[1:]:
        every = every.unionByName(some)
    place = F.row_number().over(Window.orderBy(F.desc("n_rows"), "table_name"))  # a row for each table
    return every.select("table_name", "n_rows", place.alias("place"), F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6).alias("share"))


def suggestions_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many indexes of each priority the data asks for: high for links that were found, medium for times, low for labels of few values."""
    tables = read(spark, sf_dir, ("customer", "orders", "nation", "events"))
    links = links_of(tables).select(F.col("child").alias("table_name"), "column_name", F.lit("high").alias("priority"))
    rows = [(t, c, "medium") for t, df in tables.items() for c, kind in df.dtypes if kind.startswith("timestamp")]
    for t, df in tables.items():
        texts = [c for c, kind in df.dtypes if kind == "string"]
        found = df.agg(*(F.approx_count_distinct(c).alias(c) for c in texts)).first() if texts else {}
        rows += [(t, c, "low") for c in texts if 1 < found[c] <= 20]
    every = links.unionByName(spark.createDataFrame(rows, links.schema))
    return every.groupBy("priority").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(".", "table_name", "column_name"))), ",").alias("columns"))


_SIZES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in COLUMNS)
_PLACES = f"SELECT table_name, n_rows, row_number() OVER (ORDER BY n_rows DESC, table_name) AS place, round(n_rows / sum(n_rows) OVER (), 6) AS share FROM ({_SIZES})"
_TEXTS = (("customer", "c_name"), ("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("nation", "n_name"), ("events", "event_type"), ("events", "props"))
_FEW = " UNION ALL ".join(f"SELECT 'low', '{t}.{c}' FROM {t} HAVING count(DISTINCT {c}) BETWEEN 2 AND 20" for t, c in _TEXTS)
_PRIORITIES = f"""SELECT priority, count(*) AS n, string_agg(name, ',' ORDER BY name) AS columns FROM (SELECT 'high' AS priority, child || '.' || column_name AS name FROM ({_link_oracle(("customer", "orders", "nation", "events"))})
    UNION ALL SELECT 'medium', t || '.' || c FROM (VALUES ('orders', 'o_orderdate'), ('events', 'ts')) AS v(t, c) UNION ALL {_FEW}) GROUP BY 1"""
_CARDINALITY = " UNION ALL ".join(_cardinality(*x) for x in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")))
for _run, _sql in ((found_keys, _key_oracle()), (found_links, _link_oracle()), (link_cardinality, _CARDINALITY), (suggestions_by_priority, _PRIORITIES), (tables_by_size, _PLACES)):
    QUERIES[_run.__name__] = _run
    QUERIES.sql[_run.__name__] = _sql

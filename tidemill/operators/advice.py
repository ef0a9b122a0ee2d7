"""What the catalog says about a migration: relationships, indexes, odd cases, estimates. Rules over metadata; counts come from the data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import DRIVER, Catalog, Column, ForeignKey, Index, Table, frames
from tidemill.functions.naming import camel
from tidemill.operators.checks import Unsupported, parsed
from tidemill.operators.graph import cycles
from tidemill.plans.declare import Queries

QUERIES = Queries()

#: Limits of a document store, and names that say what a table or column is for: fixed values.
MOST_FIELDS, MOST_INDEXES, MOST_BYTES, MOST_NAME = 1024, 32, 1 << 20, 64
JUNCTION_NAMES = ("_to_", "_has_", "_x_", "_join", "_link", "_rel", "_map", "_assoc")
CREATED, EXPIRY, DELETED, STATUS = ("created_at", "createdat", "creation_date", "date_created"), ("expires_at", "expiry", "expired_at", "expiration", "valid_until"), ("deleted_at", "deletedat", "is_deleted", "archived_at"), ("status", "state", "job_status")
AUTH_TABLES = ("user", "users", "account", "accounts", "member", "members", "profile", "profiles")


def is_junction(t: Table) -> bool:
    """A table that links others: named so, or with a key of its foreign keys; two of these at least, and few other columns."""
    linked = {k.column for k in t.foreign_keys}
    others = [c for c in t.columns if c.name not in linked | set(t.primary_key) and "created" not in c.name and "updated" not in c.name]
    compound = len(t.primary_key) >= 2 and linked >= set(t.primary_key)
    return (compound or any(n in t.name for n in JUNCTION_NAMES)) and len(t.foreign_keys) >= 2 and len(others) <= 3


def relationships(catalog: Catalog) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, cardinality): one-to-one where the key's column is unique, else many-to-one; many-to-many between the parents of a junction, each pair once."""
    out = []
    for t in catalog.tables.values():
        unique = {c for i in t.indexes if i.unique and len(i.columns) == 1 for c in i.columns} | (set(t.primary_key) if len(t.primary_key) == 1 else set())
        out += [(t.name, k.column, k.parent, "one-to-one" if k.column in unique else "many-to-one") for k in t.foreign_keys]
        if is_junction(t):
            out += [(a.parent, t.name, b.parent, "many-to-many") for i, a in enumerate(t.foreign_keys) for b in t.foreign_keys[i + 1 :]]
    return sorted(out)


def mutual_pairs(catalog: Catalog) -> list[tuple[str, str]]:
    """Tables that refer to each other, each pair once."""
    edges = set(catalog.edges())
    return sorted((a, b) for a, b in edges if a < b and (b, a) in edges)


def index_suggestions(t: Table) -> list[tuple[str, str, str, str]]:
    """(index, columns, priority, why): of the indexes there are, then of foreign keys, times, e-mail and status columns without one."""
    out, done = [], set()
    for i in t.indexes:
        columns = () if i.expression else i.columns
        if i.expression:
            priority, why = "low", "expression"
        elif i.predicate:
            priority, why = "medium", "partial, without its condition"
        elif i.method in ("gin", "gist"):
            priority, why = "low", "special method"
        elif i.method == "hash":
            priority, why = "low", "hash"
        elif len(columns) > 1:
            priority, why = "medium", "composite"
        else:
            priority, why = ("high", "unique") if i.unique and i.method != "btree" else ("high", "single column")
        out.append((camel(i.name), ",".join(columns), priority, why))
        done |= set(columns)
    rules = (
        (lambda c: c.name in {k.column for k in t.foreign_keys}, "high", "foreign key"),
        (lambda c: re.search("created_at|updated_at|timestamp|date", c.name, re.I) and re.search("timestamp|date", c.type), "medium", "time"),
        (lambda c: "email" in c.name.lower() and c.type in ("string", "text"), "high", "e-mail"),
        (lambda c: re.search("status|type|state|category", c.name, re.I) and c.type.upper() == "USER-DEFINED", "medium", "ordered labels"),
    )
    for holds, priority, why in rules:
        for c in t.columns:
            if c.name not in done and holds(c):
                out.append((camel(f"idx_{t.name}_{c.name}"), c.name, priority, why))
                done.add(c.name)
    return out


#: Type -> bytes of a value, as far as a type says: fixed values.
_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 8, "timestamp": 8, "timestamp_ntz": 8, "string": 256, "text": 1024, "binary": 10_240, "json": 2048}


def estimated_bytes(t: Table) -> int:
    """Bytes of a document, from its names and types."""
    size = lambda c: c.max_length or _BYTES.get(re.split(r"[(<]", c.type)[0], 64)
    return sum(len(camel(c.name)) + size(c) + 8 for c in t.columns)


def edge_cases(t: Table) -> list[tuple[str, str, str]]:
    """(severity, column, message) of what needs a look before a table is copied."""
    out: list[tuple[str, str, str]] = []
    add = lambda holds, severity, column, message: out.append((severity, column, message)) if holds else None
    add(not t.primary_key, "warning", "", "no primary key")
    add(len(t.primary_key) > 1, "info", "", f"composite primary key ({', '.join(t.primary_key)})")
    for k in t.foreign_keys:
        add(k.parent == t.name, "info", k.column, "refers to its own table")
    n, indexes, size = len(t.columns), len(t.indexes) + len(t.foreign_keys), estimated_bytes(t)
    add(n > 50, "info", "", f"wide: {n} columns")
    add(n > MOST_FIELDS, "error", "", f"over {MOST_FIELDS} fields")
    add(indexes > MOST_INDEXES, "error", "", f"over {MOST_INDEXES} indexes")
    add(0.8 * MOST_INDEXES < indexes <= MOST_INDEXES, "warning", "", f"near {MOST_INDEXES} indexes")
    add(size > MOST_BYTES, "error", "", "documents may be over 1 MB")
    for i in t.indexes:
        add(i.expression, "warning", "", f"index {i.name} is on an expression")
    for c in t.columns:
        add(len(camel(c.name)) > MOST_NAME, "error", c.name, f"name of over {MOST_NAME} characters")
        add(c.type in ("bigint", "int8") and c.name not in t.primary_key, "info", c.name, "whole numbers beyond 2^53 lose digits as doubles")
        add((c.precision or 0) > 15, "warning", c.name, "over 15 digits lose some as doubles")
        add(c.default is not None and "(" in c.default, "info", c.name, "default is a function")
        add(c.generated, "info", c.name, "computed column")
        add(c.type in ("binary", "bytea", "blob"), "info", c.name, "bytes become base64 text")
    for clause in t.checks:
        try:
            parsed(clause, [c.name for c in t.columns])
        except Unsupported as error:
            out.append(("warning", "", f"CHECK isn't enforced: {error}"))
    return out


def vector_fields(t: Table, default: int = 1536) -> list[tuple[str, int]]:
    """(column, dimensions) of columns that hold vectors, by type or name."""
    out = []
    for c in t.columns:
        size = re.match(r"vector\((\d+)\)", c.type)
        if size or c.type == "vector" or (c.type.startswith("array<") and re.search("embedding|vector", c.name, re.I)):
            out.append((c.name, int(size[1]) if size else default))
    return out


def search_index(t: Table) -> tuple[str, list[str]] | None:
    """The first text column to search in, and at most three fields to filter by."""
    text = next((c.name for c in t.columns if c.type in ("string", "text") and re.search("text|title|name|content|description|body", c.name, re.I)), None)
    if text is None:
        return None
    linked = {k.column for k in t.foreign_keys}
    return text, [c.name for c in t.columns if c.name != text and (c.name in linked or re.search("status|type|lang|category", c.name, re.I))][:3]


def cleanup_columns(t: Table) -> dict[str, str]:
    """Role -> column that a sweep would go by."""
    out = {}
    for role, names in (("created", CREATED), ("expiry", EXPIRY), ("deleted", DELETED), ("status", STATUS)):
        if found := next((c.name for c in t.columns if c.name.lower() in names), None):
            out[role] = found
    return out


def is_auth_table(t: Table) -> bool:
    """Users: by name, or with an e-mail and a password."""
    names = {c.name.lower() for c in t.columns}
    return t.name.lower() in AUTH_TABLES or (any("email" in n for n in names) and any("password" in n for n in names))


def inbound(spark: SparkSession, catalog: Catalog, least: int = 1) -> DataFrame:
    """``parent, n``: tables that ``least`` foreign keys or more refer to."""
    return frames(spark, catalog)["foreign_keys"].groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def preflight(counts: DataFrame, batch: int = 100, rate: int = 100) -> DataFrame:
    """Estimates per table from ``table_name, n_rows``: batches, seconds (best, likely, worst), bytes at 500 a row."""
    n = F.col("n_rows")
    seconds = F.ceil(F.ceil(n / batch) / F.least(F.lit(rate / 10), F.lit(10.0)))
    return counts.select(
        "table_name", "n_rows", F.ceil(n / batch).alias("batches"), *(F.round(seconds * f, 1).alias(c) for c, f in (("best_s", 1.2), ("likely_s", 1.5), ("worst_s", 2.0))), (n * 500).alias("n_bytes")
    )


def blockers(catalog: Catalog) -> list[str]:
    """Why a migration can't start as it is."""
    out = [f"{t.name}: {m}" for t in catalog.tables.values() for s, _, m in edge_cases(t) if s == "error"]
    return out + [f"cycle without a nullable key: {', '.join(c)}" for c in cycles(catalog.edges()) if not any(k.column and col.nullable for n in c for k in catalog.tables[n].foreign_keys for col in catalog.tables[n].columns if col.name == k.column and k.parent in c)]


#: A catalog with one of everything, for the rules.
SHOP = Catalog.of((
    Table("users", (Column("id", "int", False, identity=True), Column("email", "text"), Column("password_hash", "text"), Column("created_at", "timestamp"), Column("manager_id", "int")), ("id",),
          (ForeignKey("manager_id", "users", "id"),), (Index("users_email_key", ("email",), unique=True),)),
    Table("products", (Column("id", "int", False), Column("price", "decimal(20,4)", precision=20), Column("embedding", "vector(384)"), Column("photo", "binary"), Column("title", "text"), Column("kind_type", "USER-DEFINED")), ("id",),
          (), (Index("products_low_title", ("title",), expression=True), Index("products_live", ("price",), predicate="price > 0")), ("CHECK (price >= 0)", "CHECK (title ~ '^a')")),
    Table("orders", (Column("id", "int", False), Column("user_id", "int", False), Column("status", "string"), Column("deleted_at", "timestamp"), Column("total", "bigint")), ("id",), (ForeignKey("user_id", "users", "id"),)),
    Table("order_items", (Column("order_id", "int", False), Column("product_id", "int", False), Column("qty", "int")), ("order_id", "product_id"), (ForeignKey("order_id", "orders", "id"), ForeignKey("product_id", "products", "id"))),
    Table("profiles", (Column("user_id", "int", False), Column("bio", "text")), ("user_id",), (ForeignKey("user_id", "users", "id"),)),
))


def _values(names: str, *rows: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) if len(r) > 1 else f'({r[0]!r})' for r in rows)}) AS v({names})"


@QUERIES.of(
    "orders", "customer",
    sql="""SELECT table_name, n_rows, ceil(n_rows / 100.0)::BIGINT AS batches, s * 1.2 AS best_s, s * 1.5 AS likely_s, s * 2.0 AS worst_s, n_rows * 500 AS n_bytes FROM
    (SELECT *, ceil(ceil(n_rows / 100.0) / 10.0) AS s FROM (SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer))""",
)
def preflight_estimates(orders: DataFrame, customer: DataFrame) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in (("orders", orders), ("customer", customer))]
    return preflight(counts[0].union(counts[1]))


@QUERIES.of("orders", sql="SELECT CAST(count(*) - count(DISTINCT o_custkey) AS BIGINT) AS repeats, count(*) = count(DISTINCT o_orderkey) AS key_is_unique FROM orders")
def key_profile(orders: DataFrame) -> DataFrame:
    """Cardinality by the data: whether a key is one, and how often a link repeats."""
    return orders.agg((F.count("*") - F.count_distinct("o_custkey")).alias("repeats"), (F.count("*") == F.count_distinct("o_orderkey")).alias("key_is_unique"))


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with their keys and parents, by left joins of the catalog's tables."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}
    found = frames(spark, DRIVER.with_columns(tables).chosen(["orders"], exclude=["region"]))
    keys = found["foreign_keys"].select(F.col("child").alias("table_name"), "column_name", "parent")
    return found["columns"].join(keys, ["table_name", "column_name"], "left").select("table_name", "column_name", "ordinal", "type", "is_pk", "parent")


QUERIES["catalog_columns"] = catalog_columns
QUERIES.sql["catalog_columns"] = _values(
    "table_name, column_name, ordinal, type, is_pk, parent",
    *((t, c, i, k, i == 1, "PARENT" if p is None else p) for t, cols in {
        "orders": (("o_orderkey", "bigint", None), ("o_custkey", "bigint", "customer"), ("o_orderstatus", "string", None), ("o_totalprice", "double", None), ("o_orderdate", "timestamp_ntz", None), ("o_orderpriority", "string", None)),
        "customer": (("c_custkey", "bigint", None), ("c_name", "string", None), ("c_nationkey", "int", "nation"), ("c_acctbal", "double", None), ("c_mktsegment", "string", None)),
        "nation": (("n_nationkey", "int", None), ("n_name", "string", None), ("n_regionkey", "int", "region")),
    }.items() for i, (c, k, p) in enumerate(cols, 1)),
).replace("'PARENT'", "NULL")

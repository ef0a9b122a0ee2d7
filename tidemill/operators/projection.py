"""Rows as documents, by rule: names, keys, types, links, and what happens to values that can't be converted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.catalog import DRIVER, Table
from tidemill.functions import converters
from tidemill.functions.naming import camel, field_name
from tidemill.operators.keys import doc_id
from tidemill.plans.declare import Queries

QUERIES = Queries()

#: Declared type -> conversion. More can be given per projection.
CONVERSIONS: dict[str, Callable[[Column], Column]] = {
    "money": converters.money, "boolean text": converters.boolean, "timestamp": converters.epoch_ms, "timestamp_ntz": converters.epoch_ms, "date": converters.epoch_ms,
    "json": F.try_parse_json, "vector": converters.vector, "array text": converters.pg_array, "point": converters.point, "bytea": converters.bytea,
    "range": converters.range_, "numeric text": lambda c: c.try_cast("double"), "binary": F.base64,
}


@dataclass
class Projection:
    """How the rows of a table become documents.

    ``rename`` wins over the rule for names; ``skip`` leaves fields out;
    ``types`` says what a column of text holds; ``convert`` adds conversions by
    type; ``keep`` is a condition that rows must meet; ``transform`` has the
    last word on the documents (a function of a table), and rows that it makes
    null in its key ``_id`` are left out. ``valid`` has conditions by name; a
    row that breaks one has the name among its errors.
    """

    table: Table
    rename: dict[str, str] = field(default_factory=dict)
    skip: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    convert: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    keep: Column | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    valid: dict[str, Column] = field(default_factory=dict)
    empty_as_null: bool = False

    def fields(self, columns: list[str]) -> dict[str, str]:
        """Column -> field. The key of one column, or one called ``id``, is what the document id is made of, and is no field."""
        key = set(self.table.primary_key) if len(self.table.primary_key) == 1 else {c for c in self.table.primary_key if c.lower() == "id"}
        identity = {c.name for c in self.table.columns if c.identity}
        left = [c for c in columns if c not in self.skip and not (c in key or c in identity)]
        out: dict[str, str] = {}
        for c in left:
            name = first = self.rename.get(c) or field_name(camel(c))
            n = 1
            while name.lower() in {x.lower() for x in out.values()}:  # a_b and a__b: the later one is numbered
                n += 1
                name = f"{first}{n}"
            out[c] = name
        return out

    def documents(self, df: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
        """``_id``, the fields, and ``_errors``: names of fields that couldn't be converted, or whose parent is missing though the column may not be null.

        Foreign keys become the ids of their parents; where a parent's table is
        given, a row without one gets null. Each parent is one equi-join.
        """
        if self.keep is not None:
            df = df.where(self.keep)
        names, errors, out = self.fields(df.columns), [], {}
        links = {k.column: k for k in self.table.foreign_keys if k.column in names}
        for column, link in links.items():
            if parents and link.parent in parents:
                known = parents[link.parent].select(F.col(link.parent_column).alias(f"_key_{column}"))
                df = df.join(known, F.col(column) == F.col(f"_key_{column}"), "left")
                out[column] = doc_id(link.parent, f"_key_{column}")
                nullable = next((c.nullable for c in self.table.columns if c.name == column), True)
                lost = F.col(f"_key_{column}").isNull() & (F.col(column).isNotNull() if nullable else F.lit(True))
                errors.append(F.when(lost & F.lit(not nullable), F.lit(names[column])))
            else:
                out[column] = doc_id(link.parent, column)
        of = CONVERSIONS | self.convert
        for column in names:
            if column not in out:
                kind = self.types.get(column, df.schema[column].dataType.simpleString())
                value = F.col(column)
                if self.empty_as_null and df.schema[column].dataType.simpleString() == "string":
                    value = F.nullif(value, F.lit(""))
                out[column] = of[kind](value) if kind in of else value
                if kind in of:
                    errors.append(F.when(value.isNotNull() & out[column].isNull(), F.lit(names[column])))
        # what a row has to be, null counting as not
        errors += [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in self.valid.items()]
        key = self.table.primary_key
        identity = doc_id(self.table.name, key[0]) if len(key) == 1 and df.schema[key[0]].dataType.simpleString() in ("int", "bigint") else row_id(self.table.name, list(key) or df.columns)
        found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
        made = df.select(identity.alias("_id"), *(c.alias(names[n]) for n, c in out.items()), found.alias("_errors"))
        return self.transform(made).where(F.col("_id").isNotNull()) if self.transform else made


def as_json(*columns: str | Column) -> Column:
    """A document as JSON text, null fields left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def row_id(table: str, columns: list[str]) -> Column:
    """The document id of a row with a key of several columns, or of text: a digest of the key, nulls told apart from empty texts."""
    # each value with its length, so that no two keys run together to one text
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(F.lit(f"{table}:"), F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def filterable(table: Table) -> list[str]:
    """Fields worth a filter: keys, indexed ones, and short or simple ones."""
    keys = {k.column for k in table.foreign_keys} | {c for i in table.indexes for c in i.columns}
    simple = ("int", "bigint", "smallint", "boolean", "date", "timestamp", "timestamp_ntz")
    named = ("status", "type", "category", "state", "role", "kind")
    return [c.name for c in table.columns if c.name in keys or c.type in simple or any(n in c.name.lower() for n in named) or (c.max_length or 999) <= 255]


def creatable(table: Table) -> dict[str, bool]:
    """Field -> whether a new document needs it: all but made ones; needed if neither nullable nor with a default."""
    made = {c.name for c in table.columns if c.identity or c.generated} | (set(table.primary_key) if len(table.primary_key) == 1 else set())
    return {c.name: not c.nullable and c.default is None for c in table.columns if c.name not in made}


def updatable(table: Table) -> list[str]:
    return list(creatable(table))


_ID = "lpad(lower(to_hex({})), 16, '0')"


@QUERIES.of("part", sql=f"""SELECT 'part:' || {_ID.format("p_partkey")} AS _id, p_name AS title, p_type AS "pType", p_size AS "pSize", CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS price,
    CASE WHEN p_size % 3 = 0 THEN 'price' ELSE '' END AS errors FROM part WHERE p_size > 2""")  # fmt: skip
def project_document_part(part: DataFrame) -> DataFrame:
    """Renamed, skipped and converted fields, a condition on rows, and values that fail."""
    df = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("p_size").cast("string"))).alias("p_price"))
    rule = Projection(DRIVER.tables["part"], rename={"p_name": "title", "p_price": "price"}, skip=("p_brand",), types={"p_price": "money"}, keep=F.col("p_size") > 2)
    return rule.documents(df).select("*", F.array_join("_errors", ",").alias("errors")).drop("_errors")


@QUERIES.of("orders", "customer", sql=f"""SELECT 'orders:' || {_ID.format("o_orderkey")} AS _id, 'customer:' || {_ID.format("c_custkey")} AS "oCustkey", o_orderstatus AS "oOrderstatus", o_totalprice AS "oTotalprice",
    epoch_us(o_orderdate) // 1000 AS "oOrderdate", o_orderpriority AS "oOrderpriority" FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey""")  # fmt: skip
def project_all_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The whole table with its parents resolved; orphans get null."""
    return Projection(DRIVER.tables["orders"]).documents(orders, {"customer": customer.where("c_custkey % 7 <> 0")}).drop("_errors")


@QUERIES.of("conversations", sql="SELECT conv_id AS \"convId\", turn, role FROM conversations WHERE role IS NOT NULL")
def project_composite(conversations: DataFrame) -> DataFrame:
    """A key of two columns stays in the document; the transform leaves rows out by their id."""
    unknown = lambda df: df.withColumn("_id", F.when(F.col("role").isNotNull(), F.col("_id")))
    rule = Projection(DRIVER.tables["conversations"], skip=("text",), transform=unknown)
    made = rule.documents(conversations)
    return made.join(made.groupBy("_id").agg(F.count("*").alias("n")).where("n = 1"), "_id", "left_semi").drop("_id", "_errors")


@QUERIES.of("customer", sql="""SELECT c_custkey, 1 + CAST(c_custkey % 2 = 0 AS INT) AS n_fields FROM customer""")
def omit_null_fields(customer: DataFrame) -> DataFrame:
    """Null fields aren't in a document."""
    doc = as_json("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    return customer.select("c_custkey", F.size(F.json_object_keys(doc)).alias("n_fields"))


@QUERIES.of("part", sql="SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 25 THEN 'small' END, CASE WHEN p_retailprice % 2 < 1 THEN NULL ELSE 'even' END) AS errors FROM part")
def project_validated(part: DataFrame) -> DataFrame:
    """Rows with the names of the rules that they break."""
    rule = Projection(DRIVER.tables["part"], valid={"small": F.col("p_size") <= 25, "even": F.col("p_retailprice") % 2 < 1})
    made = rule.documents(part.withColumn("number", F.col("p_partkey")))
    return made.select(F.col("number").alias("p_partkey"), F.array_join("_errors", ",").alias("errors"))

"""What is known of tables besides their data: columns, keys, links, indexes, checks.

Parquet carries no keys, so they are declared. Types and columns of a declared
table can be read from its data (``with_columns``). A catalog is metadata: a
few rows per table, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys", "INFORMATION_SCHEMA")


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    nullable: bool = True
    default: str | None = None
    identity: bool = False
    max_length: int | None = None
    precision: int | None = None
    generated: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    schema: str | None = None


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    method: str = "btree"
    predicate: str | None = None
    expression: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...] = ()
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    checks: tuple[str, ...] = ()
    schema: str = "public"
    view: bool = False

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


@dataclass(frozen=True)
class Domain:
    """A named type with a rule of its own."""

    name: str
    base: str
    nullable: bool = True
    check: str | None = None


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)

    @classmethod
    def of(cls, tables: Iterable[Table]) -> Catalog:
        """Tables by name without those of system schemas; of tables with one name (and schema) the parts are merged."""
        out: dict[str, Table] = {}
        for table in tables:
            if table.schema in SYSTEM_SCHEMAS:
                continue
            out[table.name] = merged(out[table.name], table) if table.name in out else merged(table, table)
        return cls(out)

    def with_schemas(self, separator: str = "_", main: str = "public") -> Catalog:
        """Tables named after their schema where that isn't the main one."""
        named = lambda schema, name: name if schema in (None, main) else f"{schema}{separator}{name}"
        tables = {}
        for t in self.tables.values():
            keys = tuple(replace(k, parent=named(k.schema or t.schema, k.parent)) for k in t.foreign_keys)
            tables[named(t.schema, t.name)] = replace(t, name=named(t.schema, t.name), foreign_keys=keys)
        return Catalog(tables)

    def with_columns(self, frames: dict[str, DataFrame]) -> Catalog:
        """Columns that no table declares, from the schema of its data."""
        tables = dict(self.tables)
        for name, df in frames.items():
            t = tables.get(name, Table(name))
            known = {c.name for c in t.columns}
            found = tuple(Column(f.name, f.dataType.simpleString(), f.nullable and f.name not in t.primary_key) for f in df.schema if f.name not in known)
            tables[name] = replace(t, columns=t.columns + found)
        return Catalog(tables)

    def chosen(self, include: Iterable[str] | None = None, exclude: Iterable[str] = ()) -> Catalog:
        """The included tables with all their ancestors, or all, without the excluded ones."""
        names = set(self.tables) if include is None else set(include) & set(self.tables)
        todo = list(names)
        while todo:
            for key in self.tables[todo.pop()].foreign_keys:
                if key.parent in self.tables and key.parent not in names:
                    names.add(key.parent)
                    todo.append(key.parent)
        return Catalog({n: t for n, t in self.tables.items() if n in names and n not in set(exclude)})

    def edges(self) -> list[tuple[str, str]]:
        """(child, parent) without self references and tables that aren't here."""
        return sorted({(t.name, k.parent) for t in self.tables.values() for k in t.foreign_keys if k.parent in self.tables and k.parent != t.name})

    def default_order(self, name: str) -> tuple[str, ...]:
        """What a scan of pages is ordered by: the whole primary key, or all columns where there is none."""
        t = self.tables[name]
        return t.primary_key or tuple(c.name for c in t.columns)


def parse_name(name: str, schemas: Iterable[str], separator: str = "_", main: str = "public") -> tuple[str, str]:
    """(schema, table) of a name with its schema in front; the longest schema that fits."""
    for schema in sorted(schemas, key=len, reverse=True):
        if name.startswith(schema + separator):
            return schema, name[len(schema + separator) :]
    return main, name


def _first(items: Iterable, key) -> tuple:
    """Items without later ones of the same key."""
    out: dict = {}
    for item in items:
        out.setdefault(key(item), item)
    return tuple(out.values())


def merged(one: Table, other: Table) -> Table:
    """One table of two descriptions: a column is nullable if both say so, identity if either does; defaults are the first known."""
    columns: dict[str, Column] = {}
    for c in one.columns + other.columns:
        if c.name in columns:
            a = columns[c.name]
            c = replace(a, nullable=a.nullable and c.nullable, identity=a.identity or c.identity, default=a.default if a.default is not None else c.default, max_length=min((x for x in (a.max_length, c.max_length) if x is not None), default=None))
        columns[c.name] = c
    return replace(
        one,
        columns=tuple(columns.values()),
        primary_key=one.primary_key or other.primary_key,
        foreign_keys=_first(one.foreign_keys + other.foreign_keys, lambda k: (k.column, k.parent, k.parent_column)),
        indexes=_first(one.indexes + other.indexes, lambda i: i.columns),
        checks=_first(one.checks + other.checks, lambda c: c),
    )


def _keys(*links: tuple[str, str, str]) -> tuple[ForeignKey, ...]:
    return tuple(ForeignKey(*link) for link in links)


#: The tables that the driver's data has, with what Parquet doesn't say of them.
DRIVER = Catalog.of((
    Table("region", primary_key=("r_regionkey",)),
    Table("nation", primary_key=("n_nationkey",), foreign_keys=_keys(("n_regionkey", "region", "r_regionkey"))),
    Table("customer", primary_key=("c_custkey",), foreign_keys=_keys(("c_nationkey", "nation", "n_nationkey")), checks=("CHECK (c_acctbal >= -1000 AND c_acctbal <= 10000)",)),
    Table("supplier", primary_key=("s_suppkey",), foreign_keys=_keys(("s_nationkey", "nation", "n_nationkey"))),
    Table("part", primary_key=("p_partkey",), checks=("CHECK (p_size BETWEEN 1 AND 50)",)),
    Table("orders", primary_key=("o_orderkey",), foreign_keys=_keys(("o_custkey", "customer", "c_custkey")), checks=("CHECK (o_orderstatus IN ('F', 'O', 'P'))",)),
    Table("lineitem", foreign_keys=_keys(("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"))),
    Table("events", primary_key=("event_id",)),
    Table("documents", primary_key=("doc_id",)),
    Table("labels", foreign_keys=_keys(("doc_id", "documents", "doc_id"))),
    Table("pages", primary_key=("page_id",)),
    Table("benchmark", primary_key=("item_id",)),
    Table("embeddings", primary_key=("vec_id",)),
    Table("conversations", primary_key=("conv_id", "turn")),
))


def frames(spark: SparkSession, catalog: Catalog) -> dict[str, DataFrame]:
    """The catalog as tables: ``tables, columns, foreign_keys, indexes``, joined and grouped like any other."""
    every = list(catalog.tables.values())
    rows = {
        "tables": ([(t.schema, t.name, t.view, len(t.columns), ",".join(t.primary_key)) for t in every], "schema string, table_name string, is_view boolean, n_columns int, primary_key string"),
        "columns": ([(t.name, c.name, i, c.type, c.nullable, c.default, c.name in t.primary_key) for t in every for i, c in enumerate(t.columns, 1)], "table_name string, column_name string, ordinal int, type string, nullable boolean, default string, is_pk boolean"),
        "foreign_keys": ([(t.schema, t.name, k.column, k.schema or t.schema, k.parent, k.parent_column) for t in every for k in t.foreign_keys], "schema string, child string, column_name string, parent_schema string, parent string, parent_column string"),
        "indexes": ([(t.name, i.name, pos, c, i.unique, i.method) for t in every for i in t.indexes for pos, c in enumerate(i.columns, 1)], "table_name string, index_name string, position int, column_name string, is_unique boolean, method string"),
    }
    return {name: spark.createDataFrame(r, schema) for name, (r, schema) in rows.items()}

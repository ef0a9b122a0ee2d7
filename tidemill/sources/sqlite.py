"""SQLite databases as a Spark source: ranges of a key, filters in the database, keys and links as it declares them.

A table may be in several files (shards) of one schema. Each is cut into ranges
of a key at its quantiles, and a task reads a range in record batches. What
filters the database can answer go into its ``WHERE``. Files lie in a folder
that all executors mount; they are opened read-only.

Writing makes one file a task, moved to its name when it is whole; the caller
gets the names that count, so the file of a failed attempt is never read.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from tidemill.catalog import Catalog, Column, ForeignKey, Index, Table
from tidemill.plans.declare import Queries, scratch

QUERIES = Queries()
BATCH = 10_000
#: Part of a declared type -> Spark type, the first that fits: SQLite's own rules of affinity, fixed values.
AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))

_TYPES = {"bigint": LongType(), "string": StringType(), "binary": BinaryType(), "double": DoubleType()}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    return next((kind for part, kind in AFFINITY if part in (declared or "BLOB").upper()), "double")


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def mounted(path: str) -> str:
    """A path that every machine's file system has; what only Spark reads can't hold a database."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"{path} isn't a mounted folder, which SQLite needs")
    return plain


def described(path: str) -> Catalog:
    """Tables, columns, keys, links and indexes as the database declares them."""
    with closing(opened(path)) as db:
        tables = []
        for name, kind in db.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            info = db.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
            columns = tuple(Column(c, spark_type(t), not (required or pk), default) for _, c, t, required, default, pk in info)
            key = tuple(c for _, c, _, _, _, pk in sorted(info, key=lambda r: r[5]) if pk)
            links = tuple(ForeignKey(child, parent, parent_column or "") for _, _, parent, child, parent_column, *_ in db.execute(f"PRAGMA foreign_key_list({quoted(name)})"))
            indexes = tuple(
                Index(i, tuple(c or "" for _, _, c in parts), bool(unique), expression=any(c is None for _, _, c in parts))
                for _, i, unique, origin, *_ in db.execute(f"PRAGMA index_list({quoted(name)})").fetchall() if origin != "pk"
                for parts in (db.execute(f"PRAGMA index_info({quoted(i)})").fetchall(),)
            )
            tables.append(Table(name, columns, key, links, indexes, view=kind == "view"))
    return Catalog.of(tables)


_OPERATORS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def condition(f: ds.Filter, types: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQL with its values, or None if the database might answer otherwise than Spark."""
    if isinstance(f, ds.Not):
        inner = condition(f.child, types)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(f.attribute) != 1 or f.attribute[0] not in types:
        return None
    column, kind = quoted(f.attribute[0]), types[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, ds.IsNotNull):
        return f"{column} IS NOT NULL", []
    fits = {"bigint": int, "double": (int, float), "string": str}.get(kind)
    values = list(f.value) if isinstance(f, ds.In) else [getattr(f, "value", None)]
    if fits is None or not values or any(not isinstance(v, fits) or isinstance(v, bool) or v != v for v in values):
        return None
    if isinstance(f, ds.In):
        return f"{column} IN ({', '.join('?' * len(values))})", values
    return (f"{column} {_OPERATORS[type(f)]} ?", values) if type(f) in _OPERATORS else None


@dataclass
class Part(ds.InputPartition):
    path: str
    low: object = None
    high: object = None


class SqliteReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table, self.key = schema, options["table"], options.get("key")
        self.paths, self.ranges = json.loads(options["paths"]), int(options.get("ranges", 1))
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        types = {f.name: f.dataType.simpleString() for f in self.schema}
        for f in filters:
            if (found := condition(f, types)) is None:
                yield f
            else:
                self.where.append(found[0])
                self.values += found[1]

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            cuts = self.cuts(path) if self.key and self.ranges > 1 else []
            out += [Part(path, low, high) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
        return out

    def cuts(self, path: str) -> list:
        """The keys that cut a file's table into ranges of as many rows; an index gives them without a sort."""
        key, table = quoted(self.key), quoted(self.table)
        with closing(opened(path)) as db:
            (n,) = db.execute(f"SELECT count({key}) FROM {table}").fetchone()
            places = sorted({n * i // self.ranges for i in range(1, self.ranges)} - {0})
            found = (db.execute(f"SELECT {key} FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} LIMIT 1 OFFSET ?", (p,)).fetchone() for p in places)
            return sorted({r[0] for r in found})

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, values = list(self.where), list(self.values)
        if self.key and partition.high is not None:
            where.append(f"{quoted(self.key)} < ?" if partition.low is not None else f"({quoted(self.key)} < ? OR {quoted(self.key)} IS NULL)")
            values.append(partition.high)
        if self.key and partition.low is not None:
            where.append(f"{quoted(self.key)} >= ?")
            values.append(partition.low)
        arrow = to_arrow_schema(self.schema)
        text = f"SELECT {', '.join(quoted(f.name) for f in self.schema)} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with closing(opened(partition.path)) as db:
            cursor = db.execute(text, values)
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


class SqliteDataSource(ds.DataSource):
    """Options: ``paths`` (a JSON list), ``table``, ``key`` and ``ranges``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ranges"

    def schema(self) -> StructType:
        columns = described(json.loads(self.options["paths"])[0]).tables[self.options["table"]].columns
        return StructType([StructField(c.name, _TYPES[c.type]) for c in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


@dataclass
class SqliteSource:
    """The tables of a SQLite database, or of several shards of one."""

    spark: SparkSession
    paths: list[str]
    catalog: Catalog = field(init=False)

    def __post_init__(self) -> None:
        self.paths = [mounted(p) for p in ([self.paths] if isinstance(self.paths, str) else self.paths)]
        self.catalog = described(self.paths[0])
        self.spark.dataSource.register(SqliteDataSource)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def tables(self) -> list[str]:
        return sorted(self.catalog.tables)

    def read(self, table: str, key: str | None = None, ranges: int = 8) -> DataFrame:
        """A table by ranges of a key, its first key column if none is named."""
        key = key or next(iter(self.catalog.tables[table].primary_key), None)
        options = {"paths": json.dumps(self.paths), "table": table, "ranges": str(ranges)} | ({"key": key} if key else {})
        return self.spark.read.format("sqlite_ranges").options(**options).load()


def write_shards(df: DataFrame, folder: str, table: str, key: str) -> list[str]:
    """Write each partition as a database of its own; the files that count."""
    folder, names = mounted(folder), df.columns
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
    columns = ", ".join(f"{quoted(c)} {kinds[kind]}" + (" PRIMARY KEY" if c == key else "") for c, kind in df.dtypes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.db"
        with closing(sqlite3.connect(f"{path}.draft")) as db:
            db.execute(f"CREATE TABLE {quoted(table)} ({columns})")
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", rows)
            db.commit()
        os.rename(f"{path}.draft", path)
        yield pa.record_batch({"path": [path]})

    return sorted(r["path"] for r in df.mapInArrow(write, "path string").collect())  # a name for each task


@QUERIES.of("orders", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus IN ('F', 'O')")
def source_sqlite_ranges(orders: DataFrame) -> DataFrame:
    """Orders out of databases, eight ranges of each, with the conditions answered there."""
    spark = orders.sparkSession
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    source = SqliteSource(spark, write_shards(rows, scratch(spark, "sqlite"), "orders", "o_orderkey"))
    return source.read("orders", ranges=8).where((F.col("o_totalprice") > 150000) & F.col("o_orderstatus").isin("F", "O"))

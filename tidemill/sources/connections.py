"""Where tables come from: connection URLs, readers by kind, and scans of a declared table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.catalog import DRIVER, Catalog
from tidemill.plans.declare import Queries
from tidemill.sources.sqlite import SqliteSource

QUERIES = Queries()

#: Scheme -> kind of database, and kind -> port: fixed values.
SCHEMES = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "mysql2": "mysql", "mariadb": "mysql", "mssql": "mssql", "sqlserver": "mssql", "sqlite": "sqlite", "file": "sqlite"}
PORTS = {"postgresql": 5432, "mysql": 3306, "mssql": 1433}
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "sqlite": "org.sqlite.JDBC"}
#: Part of a host name -> provider.
PROVIDERS = {
    "supabase.com": "supabase", "neon.tech": "neon", "psdb.cloud": "planetscale", "railway.app": "railway", "render.com": "render", "amazonaws.com": "aws_rds", "database.windows.net": "azure_sql",
}


@dataclass(frozen=True)
class Connection:
    kind: str
    database: str
    host: str | None = None
    port: int | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    options: dict[str, str] = field(default_factory=dict)

    @property
    def url(self) -> str:
        """The connection as one URL."""
        if self.kind == "sqlite":
            return f"sqlite:///{self.database}"
        user = "" if self.user is None else quote(self.user, safe="") + ("" if self.password is None else ":" + quote(self.password, safe="")) + "@"
        more = "?" + urlencode(self.options) if self.options else ""
        return f"{self.kind}://{user}{self.host}:{self.port}/{quote(self.database)}{more}"

    def jdbc(self) -> dict[str, str]:
        """Options of Spark's JDBC reader and writer."""
        if self.kind == "sqlite":
            return {"url": f"jdbc:sqlite:{self.database}", "driver": DRIVERS["sqlite"]}
        scheme = {"mssql": "sqlserver"}.get(self.kind, self.kind)
        tail = f";databaseName={self.database}" if self.kind == "mssql" else f"/{self.database}"
        out = {"url": f"jdbc:{scheme}://{self.host}:{self.port}{tail}", "driver": DRIVERS[self.kind]}
        return out | {k: v for k, v in (("user", self.user), ("password", self.password)) if v is not None}

    def warnings(self) -> list[str]:
        """What is odd about a connection, though it parses."""
        checks = (
            (self.kind != "sqlite" and not self.password, "no password"), (self.host in ("localhost", "127.0.0.1"), "host is this machine"),
            (provider(self.host or "") is not None and self.options.get("sslmode") in (None, "disable"), "hosted database without sslmode"),
        )
        return [text for holds, text in checks if holds]


def parse_connection(text: str) -> Connection:
    """A connection of its URL; ``ValueError`` says what is wrong, without the password."""
    text = text.strip()
    if not text:
        raise ValueError("connection string is empty")
    scheme = text.split(":", 1)[0].lower()
    if scheme not in SCHEMES or ":" not in text:
        raise ValueError(f"unknown kind of database: {scheme[:20]}" if ":" in text else "a connection is kind://user:password@host:port/database")
    kind = SCHEMES[scheme]
    if kind == "sqlite":
        path = text.split(":", 1)[1]
        return Connection("sqlite", (path[3:] if path.startswith("///") else path.removeprefix("//")) or ":memory:")
    parts = urlsplit(text)
    try:
        port = parts.port or PORTS[kind]
    except ValueError:
        raise ValueError("the port is no number from 1 to 65535") from None
    if not parts.hostname:
        raise ValueError("the host is missing")
    if not (database := unquote(parts.path.lstrip("/"))):
        raise ValueError("the database is missing")
    decoded = lambda x: None if x is None else unquote(x)
    return Connection(kind, database, parts.hostname, port, decoded(parts.username), decoded(parts.password), dict(parse_qsl(parts.query, keep_blank_values=True)))


def provider(host: str) -> str | None:
    return next((name for part, name in PROVIDERS.items() if part in host.lower()), None)


def provider_of(host: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, name in reversed(PROVIDERS.items()):
        out = F.when(F.lower(host).contains(part), name).otherwise(out)
    return out


class Source(Protocol):
    """What reads tables."""

    def tables(self) -> list[str]: ...

    def read(self, table: str) -> DataFrame: ...


@dataclass
class ParquetSource:
    """A folder with a Parquet table per name."""

    spark: SparkSession
    path: str
    catalog: Catalog = field(default_factory=lambda: DRIVER)

    def tables(self) -> list[str]:
        return sorted(self.catalog.tables)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")

    def described(self) -> Catalog:
        """The catalog with the columns that the data has."""
        return self.catalog.with_columns({t: self.read(t) for t in self.tables()})


@dataclass
class JdbcSource:
    """A database; large tables are read in ``partitions`` ranges of a number column."""

    spark: SparkSession
    connection: Connection
    catalog: Catalog = field(default_factory=Catalog)

    def tables(self) -> list[str]:
        return sorted(self.catalog.tables)

    def read(self, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(**self.connection.jdbc()).option("dbtable", table)
        if column:
            reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
        return reader.load()

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.connection.jdbc()).option("query", sql).load()


_SOURCES: dict[str, Callable[..., Source]] = {"parquet": ParquetSource, "sqlite": SqliteSource} | dict.fromkeys(PORTS, JdbcSource)


def register_source(kind: str, make: Callable[..., Source]) -> None:
    _SOURCES[kind] = make


def source(kind: str, *args, **options) -> Source:
    if kind not in _SOURCES:
        raise ValueError(f"no source {kind}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[kind](*args, **options)


def query_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """SQL text over named tables, ``{name}`` for each; values are parameters ``:name``, never pasted into the text."""
    return spark.sql(sql, args=values, **tables)


@QUERIES.of("orders", "customer", sql="SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000 AND o_orderstatus <> 'x'' OR 1=1' GROUP BY 1")
def scan_sql_parameters(orders: DataFrame, customer: DataFrame) -> DataFrame:
    sql = "SELECT c_mktsegment, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > :least AND o_orderstatus <> :status GROUP BY 1"
    return query_sql(orders.sparkSession, sql, {"orders": orders, "customer": customer}, least=150000, status="x' OR 1=1")


_HOSTS = ("db.supabase.com", "x.NEON.tech", "a.psdb.cloud", "b.railway.app", "c.render.com", "d.rds.amazonaws.com", "e.database.windows.net", "own.example")
_NAMES = ", ".join(f"'{n}'" for n in (*PROVIDERS.values(), ""))


@QUERIES.of("customer", sql=f"SELECT c_custkey, nullif([{_NAMES}][c_custkey % 8 + 1], '') AS provider FROM customer")
def cloud_provider(customer: DataFrame) -> DataFrame:
    host = F.element_at(F.array(*(F.lit(h) for h in _HOSTS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return customer.select("c_custkey", provider_of(host).alias("provider"))


@QUERIES.of("conversations", sql="SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 5")
def scan_preview(conversations: DataFrame) -> DataFrame:
    """The first rows in the table's default order, which is its whole key."""
    return conversations.orderBy(*DRIVER.default_order("conversations")).limit(5).select("conv_id", "turn", "role")

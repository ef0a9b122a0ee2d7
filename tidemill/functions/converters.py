"""SQL types as document values: one column expression per type family.

A value that cannot be converted becomes null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries

QUERIES = Queries()


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "[$,]", "").try_cast("double")


def boolean(c: str | Column) -> Column:
    c = _col(c)
    return (F.lower(c) == "true") | (c == "t") | (c == "1")


def epoch_ms(c: str | Column) -> Column:
    """Milliseconds since 1970 of a time or a day. One without a zone is taken as UTC, whatever the session's zone."""
    c = _col(c)
    zone = F.typeof(c)
    plain = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01'"), c.cast("timestamp_ntz"))
    return F.when(zone == "timestamp", F.unix_millis(c.cast("timestamp"))).otherwise(plain)


def vector(c: str | Column) -> Column:
    return F.from_json(F.translate(_col(c), "{}", "[]"), "array<double>")


def pg_array(c: str | Column) -> Column:
    """The elements of a flat ``{a,"b,c",NULL}`` text. Quotes keep commas and braces, a backslash what follows it; ``NULL`` without quotes is null, and so is a text that is no flat array."""
    c = F.trim(_col(c))
    body = F.substr(c, F.lit(2), F.length(c) - 2)
    element = r'(?:"(?:[^"\\]|\\.)*"|(?:[^",{}\\]|\\.)*)'
    # a comma in front of every element makes empty ones visible too
    found = F.regexp_extract_all(F.concat(F.lit(","), body), F.lit(f",({element})"), F.lit(1))
    plain = lambda e: F.regexp_replace(F.when(e.startswith('"'), F.substr(e, F.lit(2), F.length(e) - 2)).otherwise(F.trim(e)), r"\\(.)", "$1")
    items = F.transform(found, lambda e: F.when(F.upper(F.trim(e)) != "NULL", plain(F.trim(e))))
    return F.when(body == "", F.array().cast("array<string>")).when(c.rlike(rf"^\{{{element}(?:,{element})*\}}$"), items)


def range_(c: str | Column) -> Column:
    """``[1,5)`` as lower, upper and bounds; an open side is null."""
    c = F.trim(_col(c))
    part = lambda i: F.nullif(F.trim(F.regexp_extract(c, r'^([\[(])\s*"?([^,"]*)"?\s*,\s*"?([^,"]*)"?\s*([\])])$', i)), F.lit(""))
    return F.when(part(1).isNotNull(), F.struct(part(2).alias("lower"), part(3).alias("upper"), F.concat(part(1), part(4)).alias("bounds")))


def geometric(c: str | Column, kind: str) -> Column:
    """A line, box, path, polygon or circle: its kind and its text."""
    return F.when(_col(c).isNotNull(), F.struct(F.lit(kind).alias("type"), F.trim(_col(c)).alias("value")))


def finite(c: str | Column) -> Column:
    """A number of a text; null if there is none, or it isn't finite."""
    n = _col(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def loses_digits(c: str | Column) -> Column:
    """Whether a whole number is beyond what a double holds exactly."""
    return F.abs(_col(c).cast("decimal(38,0)")) > 9007199254740991


def hstore(c: str | Column) -> Column:
    """``"a"=>"1", b=>NULL`` as a map. A backslash keeps what follows it; of a repeated key the first counts."""
    word = r'(?:"(?:[^"\\]|\\.)*"|[^\s,"=>\\]+)'
    pairs = F.regexp_extract_all(_col(c), F.lit(rf"{word}\s*=>\s*{word}"), F.lit(0))
    part = lambda e, i: F.regexp_extract(e, rf"^({word})\s*=>\s*({word})$", i)
    plain = lambda w: F.regexp_replace(F.when(w.startswith('"'), F.substr(w, F.lit(2), F.length(w) - 2)).otherwise(w), r"\\(.)", "$1")
    entries = F.transform(pairs, lambda e: F.struct(plain(part(e, 1)).alias("key"), F.when(F.upper(part(e, 2)) != "NULL", plain(part(e, 2))).alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def unknown(c: str | Column, policy: str = "text") -> Column | None:
    """A value of a type that no rule knows: as text, as null (``skip``), or an error when it is read."""
    c = _col(c)
    if policy == "text":
        return c.cast("string")
    if policy == "skip":
        return F.lit(None).cast("string")
    if policy == "error":
        return F.when(c.isNotNull(), F.raise_error(F.lit("a value of unknown type"))).cast("string")
    raise ValueError(f"no policy {policy}")


def point(c: str | Column) -> Column:
    """``(1.5,-2e3)`` as x and y; null where the text is no point, so that it counts as a failed conversion."""
    number = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
    part = [F.regexp_extract(_col(c), rf"^\s*\(\s*{number}\s*,\s*{number}\s*\)\s*$", i).try_cast("double") for i in (1, 2)]
    return F.when(part[0].isNotNull() & part[1].isNotNull(), F.struct(part[0].alias("x"), part[1].alias("y")))


def bytea(c: str | Column) -> Column:
    return F.base64(F.unhex(F.substring(_col(c), 3, 1 << 30)))


@QUERIES.of("part", sql="SELECT p_partkey, CAST(floor(p_retailprice) AS DOUBLE) AS price FROM part")
def convert_money(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", money(F.concat(F.lit("$"), F.format_number(F.floor("p_retailprice"), 0))).alias("price"))


@QUERIES.of("part", sql="SELECT p_partkey, p_size % 4 IN (0, 1, 2) AS flag FROM part")
def convert_boolean(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", boolean(F.element_at(F.array(F.lit("TRUE"), F.lit("t"), F.lit("1"), F.lit("yes")), F.col("p_size") % 4 + 1)).alias("flag"))


@QUERIES.of("events", sql="SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events")
def convert_epoch_ms(events: DataFrame) -> DataFrame:
    return events.select("event_id", epoch_ms("ts").alias("ts_ms"))


@QUERIES.of("orders", sql="SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) // 1000 AS day_ms FROM orders")
def convert_date_ms(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", epoch_ms(F.col("o_orderdate").cast("date")).alias("day_ms"))


@QUERIES.of("events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def convert_json(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@QUERIES.of("part", sql="SELECT p_partkey, p_size + 2.5 + 3 AS total, 3 AS n FROM part")
def convert_vector(part: DataFrame) -> DataFrame:
    values = vector(F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit(", 2.5, 3}")))
    return part.select("p_partkey", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).cast("decimal(12,1)").alias("total"), F.size(values).alias("n"))


@QUERIES.of("part", sql="""SELECT p_partkey, p_brand || '|a,b|NIL|' || p_type || '|say "x"|NULL' AS items, 6 AS n, p_size % 2 = 0 AS odd FROM part""")
def convert_pg_array(part: DataFrame) -> DataFrame:
    """Commas and quotes within quotes, NULL with and without them, and a text that is no array."""
    items = pg_array(F.concat(F.lit("{"), F.col("p_brand"), F.lit(',"a,b",NULL,'), F.col("p_type"), F.lit(r',"say \"x\"","NULL"}')))
    broken = pg_array(F.when(F.col("p_size") % 2 == 0, F.lit("{a,{b}")).otherwise(F.lit("{}")))
    return part.select("p_partkey", F.array_join(items, "|", "NIL").alias("items"), F.size(items).alias("n"), broken.isNull().alias("odd"))


@QUERIES.of("part", sql="SELECT p_partkey, CAST(p_size AS VARCHAR) AS lower, CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size + 5 AS VARCHAR) END AS upper, '[)' AS bounds FROM part")
def convert_range(part: DataFrame) -> DataFrame:
    end = F.when(F.col("p_size") % 2 == 0, "").otherwise((F.col("p_size") + 5).cast("string"))
    return part.select("p_partkey", range_(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(","), end, F.lit(")"))).alias("r")).select("p_partkey", "r.*")


@QUERIES.of("part", sql="SELECT p_partkey, 'circle' AS type, '<(' || p_size || ',0),5>' AS value FROM part")
def convert_geometric(part: DataFrame) -> DataFrame:
    text = F.concat(F.lit(" <("), F.col("p_size").cast("string"), F.lit(",0),5>"))
    return part.select("p_partkey", geometric(text, "circle").alias("g")).select("p_partkey", "g.*")


@QUERIES.of("part", sql="SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 1500.0 ELSE CAST(p_size AS DOUBLE) END AS value FROM part")
def convert_numeric(part: DataFrame) -> DataFrame:
    text = F.when(F.col("p_size") % 4 == 0, "NaN").when(F.col("p_size") % 4 == 1, "Infinity").when(F.col("p_size") % 4 == 2, "1.5e3").otherwise(F.col("p_size").cast("string"))
    return part.select("p_partkey", finite(text).alias("value"))


@QUERIES.of("orders", sql="SELECT o_orderkey, o_orderkey % 2 = 1 AS lossy FROM orders")
def convert_bigint_flag(orders: DataFrame) -> DataFrame:
    big = F.when(F.col("o_orderkey") % 2 == 1, F.lit(-9223372036854775807 - 1)).otherwise(F.lit(9007199254740991))
    return orders.select("o_orderkey", loses_digits(big).alias("lossy"))


@QUERIES.of("part", sql="SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, 2 AS n FROM part")
def convert_hstore(part: DataFrame) -> DataFrame:
    pairs = hstore(F.concat(F.lit('"a"=>"'), F.col("p_size").cast("string"), F.lit('", "b" => NULL')))
    return part.select("p_partkey", F.try_element_at(pairs, F.lit("a")).alias("a"), F.try_element_at(pairs, F.lit("b")).alias("b"), F.size(pairs).alias("n"))


@QUERIES.of("customer", sql="SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS as_text, CAST(NULL AS VARCHAR) AS skipped FROM customer")
def convert_unknown(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", unknown("c_nationkey").alias("as_text"), unknown("c_nationkey", "skip").alias("skipped"))


@QUERIES.of("part", sql="SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(-p_size AS DOUBLE) AS y FROM part")
def convert_point(part: DataFrame) -> DataFrame:
    text = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(","), (-F.col("p_size")).cast("string"), F.lit(")"))
    return part.select("p_partkey", point(text).alias("p")).select("p_partkey", "p.x", "p.y")


@QUERIES.of("part", sql="SELECT p_partkey, base64(encode(p_brand)) AS data FROM part")
def convert_bytea(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", bytea(F.concat(F.lit("\\x"), F.hex(F.col("p_brand").cast("binary")))).alias("data"))


@QUERIES.of("part", sql="SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value, p_size % 3 = 0 AS failed FROM part")
def convert_errors(part: DataFrame) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    return part.select("p_partkey", money(raw).alias("value"), (raw.isNotNull() & money(raw).isNull()).alias("failed"))

"""Masks for personal data: column expressions, nulls untouched, the same in every run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.naming import camel
from tidemill.plans.declare import Queries

QUERIES = Queries()


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hashed(c: str | Column, seed: str) -> Column:
    return F.sha2(F.concat(_col(c), F.lit(seed)), 256)


def redacted(c: str | Column, text: str = "[REDACTED]") -> Column:
    return F.when(_col(c).isNotNull(), F.lit(text))


def email(c: str | Column) -> Column:
    """First and last character of the local part; other texts than ``local@domain`` stay."""
    c = _col(c)
    parts = F.split(c, "@", -1)
    local, n = F.get(parts, F.lit(0)), F.length(F.get(parts, F.lit(0)))
    stars = F.repeat(F.lit("*"), F.greatest(n - 2, F.lit(1)))
    masked = F.concat(F.substring(local, 1, 1), stars, F.substring(local, -1, 1), F.lit("@"), F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & (n > 0), masked).otherwise(c)


def phone(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"\d(?=(?:\D*\d){4})", "*")


def picked(c: str | Column, choices: list[str]) -> Column:
    """One of ``choices``, by the hash of the value."""
    index = F.conv(F.substring(F.md5(_col(c)), 1, 8), 16, 10).cast("long") % len(choices)
    return F.element_at(F.array(*(F.lit(x) for x in choices)), (index + 1).cast("int"))


def _share(c: Column, salt: str = "") -> Column:
    """A number from 0 to 2**32 - 1 by the hash of a value."""
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")


def number(c: str | Column, low: int = 0, high: int = 1_000_000) -> Column:
    """A whole number from ``low`` to ``high``, by the hash of the value."""
    return F.lit(low).cast("long") + _share(_col(c)) % (high - low + 1)


def date(c: str | Column, first: str = "1970-01-01", last: str = "2029-12-31") -> Column:
    """A day from ``first`` to ``last``, by the hash of the value."""
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date"))
    return F.date_add(F.lit(first).cast("date"), (_share(_col(c)) % (days + 1)).cast("int"))


#: Strategy -> mask of a column with its options.
STRATEGIES: dict[str, Callable[..., Column]] = {
    "hash": lambda c, seed="": hashed(c, seed), "redact": lambda c, replacement="[REDACTED]": redacted(c, replacement), "email": email, "phone": phone,
    "name": lambda c, choices=("Alex", "Blake", "Casey", "Drew", "Ellis"): picked(c, list(choices)), "number": lambda c, min=0, max=1_000_000: number(c, min, max),
    "date": lambda c, first="1970-01-01", last="2029-12-31": date(c, first, last),
}

#: Field -> strategy and options, for kinds of tables: fixed values.
PRESETS: dict[str, dict[str, tuple[str, dict]]] = {
    "pii": {
        "email": ("email", {}), "phone": ("phone", {}), "ssn": ("hash", {}), "name": ("name", {}),
        "address": ("redact", {"replacement": "[ADDRESS REDACTED]"}), "credit_card": ("redact", {"replacement": "[CARD REDACTED]"}),
    },
    "financial": {"amount": ("number", {"min": 10, "max": 1000}), "account_number": ("hash", {}), "routing_number": ("hash", {})},
    "health": {
        "ssn": ("hash", {}), "medical_record_number": ("hash", {}),
        "diagnosis": ("redact", {"replacement": "[MEDICAL INFO REDACTED]"}), "medications": ("redact", {"replacement": "[MEDICAL INFO REDACTED]"}),
    },
}


def masked(df: DataFrame, rules: dict[str, tuple[str, dict] | Callable[[Column], Column]]) -> DataFrame:
    """The table with each named field masked; fields that it lacks are passed over, nulls stay null. A rule may be a function of the column."""
    out = {}
    for name, rule in rules.items():
        if name in df.columns:
            made = rule(F.col(name)) if callable(rule) else STRATEGIES[rule[0]](F.col(name), **rule[1])
            out[name] = F.when(F.col(name).isNotNull(), made)
    return df.withColumns(out)


#: Kind -> names of columns that hold it; a column counts if its name contains one. Kinds are asked in this order: fixed values.
PII_NAMES = {
    "email": ("email", "e_mail"),
    "name": ("name",),
    "phone": ("phone", "mobile", "cell", "tel"),
    "address": ("address", "street", "city", "state", "zip", "postal_code", "country"),
}
FAKE = {
    "email": lambda c: F.concat(F.lit("user"), _share(c, "email").cast("string"), F.lit("@example.com")),
    "name": lambda c: F.concat(picked(c, ["Avery", "Jordan", "Morgan", "Riley"]), F.lit(" "), picked(F.concat(c, F.lit("last")), ["Field", "Hill", "Lake", "Stone"])),
    "phone": lambda c: F.concat(F.lit("555-"), F.lpad((_share(c, "phone") % 10_000_000).cast("string"), 7, "0")),
    "address": lambda c: F.concat((_share(c, "address") % 9999 + 1).cast("string"), F.lit(" Main Street")),
}


def pii_kind(column: str) -> str | None:
    return next((kind for kind, names in PII_NAMES.items() if any(n in column.lower() for n in names)), None)


def anonymized(df: DataFrame, key: str) -> DataFrame:
    """The table with made-up values in columns whose names say that they hold personal data, the same for the same row and value in every run."""
    found = {c: kind for c in df.columns if c != key and (kind := pii_kind(c))}
    seed = lambda c: F.concat_ws("-", F.lit(c), F.col(key).cast("string"), F.col(c).cast("string"))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), FAKE[kind](seed(c))) for c, kind in found.items()})


def seed_projection(df: DataFrame) -> DataFrame:
    """Rows as a seed file has them: camel names, days and times as ISO text, bytes as base64, decimals and long integers as numbers; keys stay."""
    form = {"date": lambda c: c.cast("string"), "binary": F.base64}
    fields = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind.startswith("timestamp"):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif kind.startswith("decimal") or kind == "bigint":
            c = c.cast("double")
        fields.append(form.get(kind, lambda x: x)(c).alias(camel(f.name)))
    return df.select(*fields)


_SHARE = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@QUERIES.of("customer", sql=f"SELECT c_custkey, 10 + {_SHARE.format('CAST(c_custkey AS VARCHAR)')} % 991 AS amount FROM customer")
def mask_number(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", number("c_custkey", 10, 1000).alias("amount"))


@QUERIES.of("customer", sql=f"SELECT c_custkey, DATE '2000-01-01' + CAST({_SHARE.format('CAST(c_custkey AS VARCHAR)')} % 366 AS INTEGER) AS day FROM customer")
def mask_date(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", date("c_custkey", "2000-01-01", "2000-12-31").alias("day"))


@QUERIES.of("customer", sql=f"""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN sha256('s' || c_custkey) END AS ssn, CASE WHEN c_custkey % 2 = 0 THEN '[ADDRESS REDACTED]' END AS address,
    'a*a@x.example' AS email, upper(c_mktsegment) AS segment FROM customer""")  # fmt: skip
def mask_rules(customer: DataFrame) -> DataFrame:
    """A preset with a rule of one's own; a field that isn't there is passed over."""
    df = customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 5 <> 0 THEN concat('s', c_custkey) END AS ssn", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS address", "'a@x.example' AS email", "c_mktsegment AS segment")
    return masked(df, PRESETS["pii"] | {"segment": F.upper})


_SEED = "'c_name-' || c_custkey || '-' || c_name"


@QUERIES.of("customer", sql=f"""SELECT c_custkey, ['Avery','Jordan','Morgan','Riley'][{_SHARE.format(_SEED)} % 4 + 1] || ' ' || ['Field','Hill','Lake','Stone'][{_SHARE.format(_SEED + " || 'last'")} % 4 + 1] AS c_name,
    c_acctbal FROM customer""")  # fmt: skip
def anonymize_customer(customer: DataFrame) -> DataFrame:
    return anonymized(customer.select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


@QUERIES.of("orders", sql="""SELECT CAST(o_orderkey AS DOUBLE) AS "oOrderkey", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS "oOrderdate", o_orderstatus AS "oOrderstatus" FROM orders""")
def project_seed(orders: DataFrame) -> DataFrame:
    return seed_projection(orders.select("o_orderkey", "o_orderdate", "o_orderstatus"))


@QUERIES.of("customer", sql="SELECT c_custkey, sha256(c_name || 'seed') AS name FROM customer")
def mask_hash(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", hashed("c_name", "seed").alias("name"))


@QUERIES.of("customer", sql="SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[REDACTED]' END AS name FROM customer")
def mask_redact(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", redacted(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))).alias("name"))


@QUERIES.of("customer", sql="SELECT c_custkey, 'u' || repeat('*', greatest(length('u' || c_custkey) - 2, 1)) || right('u' || c_custkey, 1) || '@shop.example' AS mail FROM customer")
def mask_email(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", email(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@shop.example"))).alias("mail"))


@QUERIES.of("customer", sql="SELECT c_custkey, '***-***-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone FROM customer")
def mask_phone(customer: DataFrame) -> DataFrame:
    number = F.concat(F.lit("555-123-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    return customer.select("c_custkey", phone(number).alias("phone"))


@QUERIES.of("customer", sql="SELECT c_custkey, ['Ada','Ben','Cleo','Dan'][('0x' || substr(md5(c_name), 1, 8))::BIGINT % 4 + 1] AS name FROM customer")
def mask_name(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", picked("c_name", ["Ada", "Ben", "Cleo", "Dan"]).alias("name"))

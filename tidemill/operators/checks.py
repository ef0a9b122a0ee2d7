"""CHECK constraints as columns: a row is rejected where its constraint is false, not where it is null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.declare import Queries

QUERIES = Queries()

_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(-?\d+(?:\.\d+)?)|(::\s*[\w ]+?(?:\(\d+\))?(?:\[\])?(?=\s*(?:[),\]]|$|AND\b|OR\b|[<>=]))|<=|>=|<>|!=|[<>=(),\[\]])|(\"[^\"]+\"|[A-Za-z_]\w*))", re.I)
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b,
}


class Unsupported(ValueError):
    """A clause that can't be said as a column; it is reported, never guessed at."""


class _Clause:
    """Reads one CHECK clause: comparisons, lengths, IN, ANY, BETWEEN, IS NULL, booleans, AND, OR, NOT."""

    def __init__(self, text: str, columns: set[str]):
        self.columns, self.at = columns, 0
        self.tokens: list[tuple[str, str]] = []
        text, end = text.strip(), 0
        while end < len(text):
            m = _TOKEN.match(text, end)
            if not m or m.end() == end:
                raise Unsupported(f"can't read: {text[end : end + 20].strip()}")
            end = m.end()
            kind = ("text", "number", "sign", "word")[m.lastindex - 1]
            if not m[m.lastindex].startswith("::"):  # casts say nothing here: columns have types
                self.tokens.append((kind, m[m.lastindex]))

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1].upper() in words and self.tokens[self.at][0] in ("word", "sign")

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise Unsupported(f"{word} expected")

    def whole(self) -> Column:
        self.take("CHECK")
        out = self.either()
        if self.at < len(self.tokens):
            raise Unsupported(f"not understood: {self.tokens[self.at][1]}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.take("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.take("AND"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.take("NOT"):
            return ~self.one()
        start = self.at
        if self.take("("):
            try:
                out = self.either()
                self.need(")")
                if not self.peek(*_COMPARE, "IN", "BETWEEN", "IS"):
                    return out
            except Unsupported:
                pass
            self.at = start  # the bracket is around an operand
        return self.test()

    def test(self) -> Column:
        left = self.operand()
        turned = self.take("NOT")
        if self.take("BETWEEN"):
            low = self.operand()
            self.need("AND")
            out = left.between(low, self.operand())
        elif self.take("IN"):
            out = left.isin(*self.items("(", ")"))
        elif self.take("IS"):
            turned = self.take("NOT") or turned
            self.need("NULL")
            out = left.isNull()
        elif self.at < len(self.tokens) and self.tokens[self.at][1] in _COMPARE:
            sign = self.tokens[self.at][1]
            self.at += 1
            if self.take("ANY"):
                if sign != "=":
                    raise Unsupported("ANY with another sign than =")
                self.need("(")
                deeper = self.take("(")
                self.need("ARRAY")
                out = left.isin(*self.items("[", "]"))
                if deeper:
                    self.need(")")
                self.need(")")
            else:
                out = _COMPARE[sign](left, self.operand())
        else:
            out = left  # a boolean column
        return ~out if turned else out

    def items(self, left: str, right: str) -> list[Column]:
        self.need(left)
        out = [self.operand()]
        while self.take(","):
            out.append(self.operand())
        self.need(right)
        return out

    def operand(self) -> Column:
        if self.take("("):
            out = self.operand()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise Unsupported("the clause ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return F.lit(text[1:-1].replace("''", "'"))
        if kind == "number":
            return F.lit(float(text) if "." in text else int(text))
        if kind == "word" and text.upper() in ("TRUE", "FALSE"):
            return F.lit(text.upper() == "TRUE")
        if kind == "word" and text.lower() in ("length", "char_length", "character_length") and self.take("("):
            out = F.length(self.operand())
            self.need(")")
            return out
        name = text.strip('"')
        if kind == "word" and name in self.columns:
            return F.col(name)
        raise Unsupported(f"no column or value: {text}")


def parsed(clause: str, columns: set[str] | list[str]) -> Column:
    """The column that a CHECK clause says, of known columns; ``Unsupported`` where it says something else.

    The whole clause is read, so no part of it is dropped in silence, and
    nothing of it reaches SQL as text.
    """
    return _Clause(clause, set(columns)).whole()


def enforced(df: DataFrame, clauses: tuple[str, ...] | list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that break no clause, and the others with ``_errors``, the clauses that they break. A clause that is null for a row isn't broken."""
    broken = F.array_compact(F.array(*(F.when(rejected(parsed(c, df.columns)), F.lit(c)) for c in clauses)))
    judged = df.withColumn("_errors", broken)
    return judged.where(F.size("_errors") == 0).drop("_errors"), judged.where(F.size("_errors") > 0)


def rejected(constraint: Column) -> Column:
    return ~F.coalesce(constraint, F.lit(True))


@QUERIES.of("lineitem", sql="SELECT count(*) AS n, count(*) FILTER (NOT (l_quantity >= 5 AND l_quantity <= 40)) AS n_rejected FROM lineitem")
def check_range(lineitem: DataFrame) -> DataFrame:
    return lineitem.agg(F.count("*").alias("n"), F.count_if(rejected(F.col("l_quantity").between(5, 40))).alias("n_rejected"))


@QUERIES.of("orders", sql="SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def check_in(orders: DataFrame) -> DataFrame:
    return orders.where(rejected(F.col("o_orderstatus").isin("F", "O"))).select("o_orderkey")


@QUERIES.of("part", sql="SELECT p_partkey FROM part WHERE length(p_type) > 5 OR length(p_type) < 4")
def check_length(part: DataFrame) -> DataFrame:
    return part.where(rejected(parsed("CHECK ((length((p_type)::text) <= 5) AND (char_length(p_type) >= 4))", part.columns))).select("p_partkey")


def _counted(name: str, table: str, clause: str, where: str) -> None:
    """A query that counts the rows that break a clause."""

    def run(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n"), F.count_if(rejected(parsed(clause, df.columns))).alias("n_rejected"))

    run.__name__ = name
    QUERIES.of(table, sql=f"SELECT count(*) AS n, count(*) FILTER (NOT ({where})) AS n_rejected FROM {table}")(run)


_counted("check_min", "lineitem", "CHECK (l_quantity >= 10)", "l_quantity >= 10")
_counted("check_max", "lineitem", "CHECK ((l_discount < (0.05)::numeric))", "l_discount < 0.05")
_counted("check_both_bounds", "part", "CHECK (((p_size >= 18) AND (p_size <= 40)))", "p_size >= 18 AND p_size <= 40")
_counted("check_between", "part", "CHECK (p_size BETWEEN 5 AND 30 AND NOT p_size = 7)", "p_size BETWEEN 5 AND 30 AND NOT p_size = 7")
_counted("check_any", "orders", "CHECK ((o_orderstatus = ANY (ARRAY['F'::text, 'O'::text])))", "o_orderstatus IN ('F', 'O')")
_counted("check_or", "orders", "CHECK (o_orderstatus IN ('F', 'it''s') OR o_totalprice > 200000)", "o_orderstatus IN ('F', 'it''s') OR o_totalprice > 200000")


@QUERIES.of("customer", sql="SELECT c_custkey, c_custkey % 4 = 0 AS no_name, c_acctbal < 0 AS in_debt FROM customer")
def check_not_null_bool(customer: DataFrame) -> DataFrame:
    df = customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), (F.col("c_acctbal") >= 0).alias("solvent"))
    broken = {"no_name": "CHECK (name IS NOT NULL)", "in_debt": "CHECK (solvent = true)"}
    return df.select("c_custkey", *(rejected(parsed(c, df.columns)).alias(n) for n, c in broken.items()))


@QUERIES.of("customer", sql="SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_acctbal < 0 THEN 2 ELSE 1 END AS n_errors FROM customer WHERE c_custkey % 3 = 0 OR c_acctbal < 0")
def check_reject_table(customer: DataFrame) -> DataFrame:
    """The rows that a set of clauses rejects, with what they break."""
    df = customer.select("c_custkey", "c_acctbal", (F.col("c_custkey") % 3 != 0).alias("fine"))
    return enforced(df, ["CHECK (c_acctbal >= 0)", "CHECK (fine)"])[1].select("c_custkey", F.size("_errors").alias("n_errors"))


@QUERIES.of("customer", sql="SELECT c_custkey, c_acctbal >= 0 AS valid FROM customer")
def check_reject_split(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", (~rejected(F.col("c_acctbal") >= 0)).alias("valid"))

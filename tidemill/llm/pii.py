"""Personal data by patterns, checksums and context words; built-in functions only.

Patterns propose spans, checks confirm them (octets of addresses, Luhn for
cards, mod-97 for bank accounts, digit counts for phones), and words around a
span raise or lower its score. Work is a projection: one pass, no exchange.

Spark returns matched strings without their places. Cutting the same text at
the same pattern gives what stands between them, and running sums over the
lengths of both give the places.

The patterns say the same as the plain ones in their comments, written so
that a text of one long word costs linear time: possessive runs, and a start
only where a run starts (or the last match ended).

Defined results: a null text counts as empty; repeated rows are judged one by
one; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import spans_text

#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an account -> the countries that have it: the registry, then countries that use accounts without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST AO CV GW MZ",
    26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Letters and digits with single spaces, as many as the country has, so that what follows an account is not taken for its end.
IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
    + r")(?![A-Za-z0-9])"
)
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"

CONTEXT = 40
#: Kind -> score without context, words that raise it, words that lower it.
SCORES = {
    "email": (0.8, "mail|contact|write", "example|noreply"),
    "ip": (0.6, "address|host|server|client", "version|section|release"),
    "card": (0.7, "card|visa|credit|payment|pay", "order|serial|isbn"),
    "phone": (0.6, "phone|call|mobile|tel|fax", "serial|version"),
    "iban": (0.8, "iban|bank|account|konto|compte|cuenta", "serial"),
}
KINDS = tuple(SCORES)
_BLOCK = 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        doubled = d * 2
        return total + F.when(i % 2 == 0, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of letters and digits leaves 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def running_starts(lengths: str) -> Column:
    """Sum of the elements before each element of a column, in two levels: within blocks, and over the sums of blocks.

    ``lengths`` is a column of its own, since what a lambda refers to is made
    again for each of its calls.
    """
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / _BLOCK).cast("int"))
    here = lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))
    onward = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    zero = F.lit(0).cast("long")
    sums = F.transform(blocks, lambda b: F.aggregate(here(b), zero, lambda a, x: a + x))
    bases = F.aggregate(sums, F.array(zero), onward)
    # one base more than blocks: the last pair has no block
    within = F.zip_with(blocks, bases, lambda b, base: F.when(b.isNotNull(), F.slice(F.aggregate(here(b), F.array(base), onward), F.lit(1), F.size(here(b)))))
    return F.flatten(F.filter(within, lambda w: w.isNotNull()))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


_PATTERNS = {"email": (EMAIL, r"@"), "ip": (IP, r"[0-9]\.[0-9]"), "card": (CARD, None), "phone": (PHONE, r"\+[0-9]"), "iban": (IBAN, r"[A-Z]{2}[0-9]{2}")}


def _lengths(matches: str, gaps: str) -> Column:
    """Code points of each match and of the gap before it."""
    return F.transform(F.sequence(F.lit(1), F.size(matches)), lambda i: (F.length(F.get(gaps, i - 1)) + F.length(F.get(matches, i - 1))).cast("long"))


def _spans(kind: str, matches: str, gaps: str, lengths: str) -> Column:
    """Confirmed spans of one kind from its matches and the gaps around them."""
    score, raising, lowering = SCORES[kind]

    def span(start: Column, i: Column) -> Column:
        match, before, after = F.get(matches, i), F.get(gaps, i), F.get(gaps, i + 1)
        first = start + F.length(before)
        near = F.lower(F.concat(F.substring(before, -CONTEXT, CONTEXT), F.lit(" "), F.substring(after, 1, CONTEXT)))
        value = F.lit(score) + F.when(near.rlike(rf"\b(?:{raising})"), 0.2).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{lowering})"), 0.3).otherwise(0.0)
        return F.struct(
            first.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (first + F.length(match)).alias("end"),
            F.lit(kind).alias("kind"), F.round(value, 2).alias("score"), _valid(kind, match).alias("valid"),
        )

    found = F.filter(F.transform(running_starts(lengths), span), lambda s: s["valid"])
    return F.when(F.size(matches) > 0, found)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: ``found``, confirmed spans (start, rank, end, kind, score) by start, then kind."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, (pattern, needs) in _PATTERNS.items():
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"_m_{kind}", F.when(F.col("text").rlike(needs), matches).otherwise(none) if needs else matches)
    for kind, (pattern, _) in _PATTERNS.items():
        rows = rows.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    none = F.array().cast("array<bigint>")
    for kind in KINDS:
        rows = rows.withColumn(f"_l_{kind}", F.when(F.size(f"_m_{kind}") > 0, _lengths(f"_m_{kind}", f"_g_{kind}")).otherwise(none))
    kind_spans = [_spans(kind, f"_m_{kind}", f"_g_{kind}", f"_l_{kind}") for kind in KINDS]
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,valid:boolean>>")
    return rows.select("doc_id", F.sort_array(F.concat(*(F.coalesce(s, empty) for s in kind_spans))).alias("found"))


def pii_digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["rank"] < 4)
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:4]),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
        count("iban"),
        F.coalesce(F.array_max("found.score"), F.lit(0.0)).alias("top_score"),
    )

"""Names of tables and fields: cases, reserved words, quoting. Names are metadata, so these are plain functions of strings."""

from __future__ import annotations

import re

#: Words that a script language keeps for itself, and fields that a document has anyway: fixed values.
RESERVED = frozenset(
    "break case catch continue debugger default delete do else finally for function if in instanceof new return switch this throw try typeof var void while with "
    "class const enum export extends import super implements interface let package private protected public static yield await async _id _creationTime".split()
)


def camel(name: str) -> str:
    """``order_key`` -> ``orderKey``; underscores in front stay."""
    lead = re.match("_*", name)[0]
    first, *rest = name[len(lead) :].lower().split("_")
    return lead + first + "".join(part[:1].upper() + part[1:] for part in rest)


def pascal(name: str) -> str:
    name = camel(name)
    return name[:1].upper() + name[1:]


def snake(name: str) -> str:
    return re.sub("([A-Z])", r"_\1", name).lower().removeprefix("_")


def field_name(name: str) -> str:
    """A reserved word gets an underscore behind it."""
    return name + "_" if name in RESERVED else name


def is_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", name) is not None and name not in RESERVED


def identifier(name: str) -> str:
    """The nearest valid identifier."""
    name = re.sub(r"[^A-Za-z0-9_$]", "_", name) or "_"
    return field_name("_" + name if name[0].isdigit() else name)


def literal(text: str) -> str:
    """A string as a quoted literal."""
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(plain, escaped)
    return f"'{text}'"


_QUOTES = {"postgresql": '""', "sqlite": '""', "mysql": "``", "mssql": "[]"}


def quoted(name: str, dialect: str = "postgresql") -> str:
    """A name in the quotes of a dialect, the closing one doubled within."""
    left, right = _QUOTES[dialect]
    return left + name.replace(right, right * 2) + right


def readable_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024


def readable_seconds(s: float) -> str:
    if s < 60:
        return f"{s:.0f}s"
    return f"{s // 60:.0f}m {s % 60:.0f}s" if s < 3600 else f"{s // 3600:.0f}h {s % 3600 // 60:.0f}m"

"""HTML character references decoded as one Spark expression (no Python at run time).

The rules are those of the HTML standard as Python's ``html.unescape`` applies them: decimal and
hexadecimal references with or without a semicolon, all names of the standard, and the names that
may lack the semicolon, of which the longest one that starts an unknown name counts. Text is cut at
each ``&``; what follows is looked up in a two-level map of the names (first two characters, then the
name), a constant of the plan. Values without ``&`` are passed on untouched.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Lengths of the names that may lack the semicolon, longest first.
BARE_LENGTHS = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)
REPLACEMENT = "�"


#: Private-use characters that separate the entries of the tables below.
_ENTRY, _INNER, _VALUE, _TEXT = "\ue000", "\ue001", "\ue002", "\ue003"


@cache
def _names() -> str:
    """The names as one text: first two characters, then the names that start with them and their texts."""
    table: dict[str, list[str]] = {}
    for name, text in html5.items():
        table.setdefault(name[:2], []).append(f"{name}{_TEXT}{text}")
    return _ENTRY.join(f"{start}{_VALUE}{_INNER.join(names)}" for start, names in table.items())


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows_1252() -> list[str]:
    """What the numbers 128 to 159 stand for: their Windows characters, or the control characters."""
    return [bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0)]


def _character(number: Column) -> Column:
    """The text of a numeric reference."""
    one = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    windows = F.split(F.lit(_ENTRY.join(_windows_1252())), _ENTRY)
    control = number.between(1, 8) | number.between(0x0E, 0x1F) | (number == 0x7F) | (number == 0x0B)
    none = control | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit(REPLACEMENT))
            .when(number.between(0x80, 0x9F), F.get(windows, (number - 0x80).cast("int")))
            .when(none, F.lit("")).otherwise(one))


def _numeric(ref: Column) -> Column:
    digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
    base = lambda b: F.coalesce(F.conv(digits, b, 10).cast("long"), F.lit(0).cast("long"))
    number = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).when(ref.rlike("^#[xX]"), base(16)).otherwise(base(10))
    return _let(number, _character)


def _named(ref: Column) -> Column:
    starts = F.str_to_map(F.lit(_names()), F.lit(_ENTRY), F.lit(_VALUE))  # a constant of the plan
    inner = _let(F.try_element_at(starts, F.substring(ref, 1, 2)), lambda t: F.str_to_map(t, F.lit(_INNER), F.lit(_TEXT)))
    return _let(inner, lambda names: _decoded_name(ref, names))


def _decoded_name(ref: Column, names: Column) -> Column:
    find = lambda n: F.try_element_at(names, n)
    bare = F.coalesce(*[F.when(F.length(ref) > n, F.concat(find(F.substring(ref, 1, n)), F.substring(ref, F.lit(n + 1), F.length(ref)))) for n in BARE_LENGTHS])
    return F.coalesce(find(ref), bare, F.concat(F.lit("&"), ref))


def _after_ampersand(part: Column) -> Column:
    def decoded(ref: Column) -> Column:
        rest = F.substring(part, F.length(ref) + 1, F.length(part))
        return (F.when(ref == "", F.concat(F.lit("&"), part))
                .when(ref.startswith("#"), F.concat(_numeric(ref), rest))
                .otherwise(F.concat(_named(ref), rest)))

    return _let(F.regexp_extract(part, REFERENCE, 1), decoded)


def unescape(col: Column) -> Column:
    """``html.unescape`` of a string column; null stays null."""
    parts = F.split(col, "&", -1)
    decoded = _let(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), _after_ampersand), "")))
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)

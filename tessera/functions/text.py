"""Text cleaning (column functions).

Order: HTML-entity unescape -> collapse every whitespace run to one space -> delete the
characters ``& - " \\`` -> strip. All of it is JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.entities import unescape

# FIXED VALUES: Python's str.isspace() set (Java's \s lacks U+001C-U+001F, U+0085, U+00A0, ...)
WHITESPACE_RUN = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
DELETED_CHARS = '&-"\\'


def collapse_whitespace(col: Column) -> Column:
    return F.regexp_replace(col, WHITESPACE_RUN, " ")


def clean_text(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.translate(collapse_whitespace(unescape(c)), DELETED_CHARS, "")
    # after the collapse the only whitespace left is ' ', so trimming spaces is a full strip
    return F.trim(out)


def strip_unicode(col: Column) -> Column:
    """Python ``str.strip()`` for any whitespace, JVM-side."""
    return F.regexp_replace(col, f"^{WHITESPACE_RUN}|{WHITESPACE_RUN}$", "")

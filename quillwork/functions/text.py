"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text form of a number that is safe to treat as one. Leading zeros, inf/nan words,
# blanks and type suffixes are refused.
NUMBER_PATTERN = r"^\s*[+-]?(?!0\d)(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


# The characters counted as white space.
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def title(c: Column) -> Column:
    """Capitalise after every non-letter; ``initcap`` only does so after white space."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def safe_number(c: Column, is_numeric: bool = False, is_boolean: bool = False) -> Column:
    """Cautious number: NULL for booleans and for text that is not a plain finite number.

    Numbers pass unchanged, NaN excepted.
    """
    if is_boolean:
        return F.lit(None).cast("double")
    if is_numeric:
        value = c.cast("double")
        return F.when(~F.isnan(value), value)
    text = c.cast("string")
    value = F.when(text.rlike(NUMBER_PATTERN), strip(text).try_cast("double"))
    return F.when(F.abs(value) != F.lit(float("inf")), value)


def newlines(c: Column) -> Column:
    """CRLF and CR become LF, NUL characters go."""
    return F.regexp_replace(F.regexp_replace(c, "\\x00", ""), r"\r\n?", "\n")


def json_text(c: Column) -> Column:
    """``c`` as a quoted JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c

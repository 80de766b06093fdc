"""Text expressions: white space, base64url, UTF-8, headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space.
_WHITESPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, _WHITESPACE_CODES))


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (`trim` alone takes only spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze_line_ends(text: Column) -> Column:
    """White space before a line break goes, then both ends are stripped.

    That leaves no blank line and no line with white space at its end, so it is
    done line by line. A pattern over the whole text gives the same but takes
    many times longer, without bound on long runs of spaces.
    """
    lines = F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit(WHITESPACE)))
    return strip(F.array_join(F.filter(lines, lambda line: line != ""), "\n"))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def comparable(text: Column) -> Column:
    """Form in which two category names are compared."""
    return F.upper(strip(text))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once.

    Inside array functions Spark does not share what an expression repeats.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def decode_base64url(data: Column) -> Column:
    """base64url text, padded or not, to bytes.

    A lone last character carries no whole byte and would fail the task, so it
    is cut. Only text of an unusual length is looked at for that.
    """

    def whole(text: Column) -> Column:
        bare = text
        for extra in ("\n", "\r", "="):
            bare = F.replace(bare, F.lit(extra), F.lit(""))
        return once(bare, lambda t: F.when(F.length(t) % 4 == 1, F.left(t, F.length(t) - 1)).otherwise(t))

    def decode(text: Column) -> Column:
        usual = (F.length(text) % 4 == 0) & ~text.contains("\n") & ~text.contains("\r")
        return F.unbase64(F.when(usual, text).otherwise(whole(text)))

    standard = F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return once(standard, decode)


def decode_utf8(data: Column) -> Column:
    """Bytes to text; each malformed sequence becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name in any letter case, else null."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(hits, F.lit(1))["value"]

"""HTML to text with built-in expressions."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# What lies between two text nodes: a comment, an element whose text is not
# shown, a tag (with `>` allowed inside quotes), a declaration. The `<` they
# share stands first, so that most characters are passed over at one look.
_BETWEEN = "<(?:" + "|".join(
    (
        r"(?s:!--.*?(?:-->|\z))",
        r"(?is:(script|style|template)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z))",
        # These two may be left open: the next of them or the end of the ruby closes them.
        r"(?is:r[tp](?=[\s/>])[^>]*>.*?(?:</r[tp]\s*>|(?=<r[tp][\s/>])|(?=</ruby\s*>)|\z))",
        r"""/?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""",
        r"/?[a-zA-Z][^>]*>",
        r"[!?/][^>]*>",
    )
) + ")"

# Replaced one after the other, the ampersand last, so that `&amp;lt;` ends as `&lt;`.
_COMMON = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&"))
_UNCOMMON = "&(?!(?:" + "|".join(name for name, _ in _COMMON) + ");)"

_REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][-.a-zA-Z0-9]*;?|&|[^&]+"

# What the numbers 128..159 stand for in old pages (windows-1252).
_OLD_PAGES = {
    code: bytes([code]).decode("windows-1252", errors="ignore") for code in range(128, 160)
}


def _constant_map(pairs: dict[str, str]) -> Column:
    """One literal, folded into a map when the query is planned."""
    text = "\x02".join(f"{key}\x01{value}" for key, value in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _names() -> Column:
    return _constant_map({name: chr(code) for name, code in name2codepoint.items()})


def _old_pages() -> Column:
    return _constant_map({str(code): c for code, c in _OLD_PAGES.items() if c})


def _character(code: Column) -> Column:
    """Code point to text. `chr` stops at 255, so the bytes of UTF-32 are decoded."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    four_bytes = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(
        valid,
        F.coalesce(F.try_element_at(_old_pages(), code.cast("string")), F.decode(four_bytes, "UTF-32")),
    ).otherwise(F.lit("�"))


def _resolve(token: Column) -> Column:
    """One piece of text: a reference becomes its character, an unknown name keeps its letters."""
    bare = F.rtrim(token, F.lit(";"))
    digits = F.regexp_replace(bare, "^&#[xX]?0*", "")
    code = (
        F.when(F.length(digits) > 8, F.lit(0).cast("bigint"))
        .when(bare.rlike("^&#[xX]"), F.conv(digits, 16, 10).try_cast("bigint"))
        .otherwise(digits.try_cast("bigint"))
    )
    name = F.regexp_replace(bare, "^&", "")
    return (
        F.when(~token.startswith("&") | (token == "&"), token)
        .when(token.startswith("&#"), _character(F.coalesce(code, F.lit(0).cast("bigint"))))
        .otherwise(F.coalesce(F.try_element_at(_names(), name), bare))
    )


def unescape(text: Column) -> Column:
    """Character references to characters.

    Text without `&` is left alone and the common names take plain
    replacements; only other references pay for the split into pieces.
    """
    common = reduce(
        lambda t, pair: F.replace(t, F.lit(f"&{pair[0]};"), F.lit(pair[1])), _COMMON, text
    )
    pieces = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(~text.rlike(_UNCOMMON), common)
        .otherwise(F.array_join(F.transform(pieces, _resolve), ""))
    )


# Tags that open and close a template, and whole pieces that hold none that count.
_TEMPLATE_PIECE = "|".join((
    r"(?s:<!--.*?(?:-->|\z))",
    r"(?is:<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z))",
    r"(?i:<template(?=[\s/>])[^>]*>)",
    r"(?i:</template\s*>)",
    r"[^<]+",
    r"<",
))
_OPENS, _CLOSES = r"(?i)^<template[\s/>]", r"(?i)^</template\s*>"
_OPEN_ANYWHERE = r"(?i)<template[\s/>]"


def _without_templates(html: Column) -> Column:
    """A page without the templates in it, whatever they hold; a tag stands for each outermost one.

    Depth is counted along the pieces: a template ends where as many were closed as opened.
    """
    def step(state: Column, piece: Column) -> Column:
        opens = piece.rlike(_OPENS)
        closes = piece.rlike(_CLOSES) & (state["depth"] > 0)
        depth = state["depth"] + opens.cast("int") - closes.cast("int")
        shown = F.when((state["depth"] > 0) | closes, F.lit("")).when(opens, F.lit("<wbr>")).otherwise(piece)
        return F.struct(depth.alias("depth"), F.array_append(state["shown"], shown).alias("shown"))

    pieces = F.regexp_extract_all(html, F.lit(_TEMPLATE_PIECE), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("shown"))
    return F.array_join(F.aggregate(pieces, start, step)["shown"], "")


def html_to_text(html: Column) -> Column:
    """Text nodes, each stripped, empty ones left out, joined by one space."""
    # One template is told apart by the pattern below; of several, one may stand in another.
    several = F.regexp_count(html, F.lit(_OPEN_ANYWHERE)) > 1
    flat = F.when(several, _without_templates(html)).otherwise(html)
    nodes = F.split(flat, _BETWEEN)
    shown = F.transform(nodes, lambda node: strip(unescape(node)))
    return F.array_join(F.filter(shown, lambda node: node != ""), " ")

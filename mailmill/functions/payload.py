"""Body text of a recursive payload record.

The record is read with a schema nested to a given depth and walked by nested
array functions, so the rows are neither exploded nor grouped again: the whole
walk is one projection. Records nested deeper than that, or not of the schema, hand
only their own payload to a small Arrow function that walks it token by token, to any
depth, and says why where there is nothing to walk.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .html import html_to_text
from .text import decode_base64url, decode_utf8, once, or_empty

DEFAULT_DEPTH = 6

_TEXT = StringType()
_HEADERS = ArrayType(
    StructType([StructField("name", _TEXT), StructField("value", _TEXT)])
)
# The JSON reader's own limits would turn a longer or deeper record into nulls.
NO_LIMITS = {"maxStringLen": "2147483647", "maxNestingDepth": "2147483647"}
_LEAVES = ArrayType(StructType([StructField("mime", _TEXT), StructField("data", _TEXT)]))
_WALKED = StructType([StructField("headers", _HEADERS), StructField("leaves", _LEAVES), StructField("error", _TEXT)])
_CORRUPT = "_corrupt_record"
NOT_JSON, NOT_OBJECT = "payload is no JSON", "payload is no JSON object"


def payload_schema(depth: int, top: bool = True) -> StructType:
    """Payload with `depth` levels of parts; parts below that stay JSON text."""
    parts = ArrayType(payload_schema(depth - 1, top=False)) if depth else _TEXT
    fields = [
        StructField("mimeType", _TEXT),
        StructField("body", StructType([StructField("data", _TEXT)])),
        StructField("parts", parts),
    ]
    whole = [StructField("headers", _HEADERS), StructField(_CORRUPT, _TEXT)]
    return StructType((whole if top else []) + fields)


def _is_text(part: Column) -> Column:
    return or_empty(part["mimeType"]).isin("text/plain", "text/html") & (
        or_empty(part["body"]["data"]) != ""
    )


def _leaves(part: Column, depth: int) -> Column:
    """Text parts in reading order; a text part ends the walk below it."""
    own = F.array(
        F.struct(part["mimeType"].alias("mime"), part["body"]["data"].alias("data"))
    )
    if depth == 0:
        below = F.array().cast(_LEAVES)
    else:
        below = F.flatten(F.transform(part["parts"], lambda p: _leaves(p, depth - 1)))
    # `flatten` of a list with a null in it is null.
    return F.when(_is_text(part), own).otherwise(F.coalesce(below, F.array().cast(_LEAVES)))


def _goes_deeper(part: Column, depth: int) -> Column:
    """Whether the walk may reach parts below the last level."""
    if depth == 0:
        # An empty list of parts hides nothing. No list at all may be one too deep for the reader.
        below = part["parts"].isNull() | ~part["parts"].isin("[]", "null")
    else:
        below = F.exists(part["parts"], lambda p: _goes_deeper(p, depth - 1))
    return F.coalesce(~_is_text(part) & below, F.lit(False))


_TOKEN = re.compile(r'[ \t\n\r]*(?:([][{}:,])|("(?:[^"\\]|\\.)*+")|([-+.0-9A-Za-z]+))', re.S)
_CLOSES = {"]": list, "}": dict}


def parse_json(text: str):
    """A JSON value of any depth, read token by token with a stack of its own."""
    top: list = []
    # Open lists and records, each with the key it waits to fill.
    stack: list[list] = [[top, None]]
    # What may come next: a value, a key, a colon, or a comma or an end.
    wants, empty, at = "value", False, 0

    def put(value) -> None:
        holder, key = stack[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)

    while match := _TOKEN.match(text, at):
        at = match.end()
        mark, quoted, bare = match.groups()
        holder = stack[-1][0]
        if wants == "colon":
            if mark != ":":
                raise ValueError(f"no colon before {at}")
            wants, empty = "value", False
        elif mark in _CLOSES:
            if len(stack) == 1 or not isinstance(holder, _CLOSES[mark]) or not (wants == "more" or empty):
                raise ValueError(f"{mark} too much before {at}")
            stack.pop()
            wants, empty = "more", False
        elif wants == "more":
            if mark != "," or len(stack) == 1:
                raise ValueError(f"no comma before {at}")
            wants, empty = ("key" if isinstance(holder, dict) else "value"), False
        elif wants == "key":
            if quoted is None:
                raise ValueError(f"no key before {at}")
            stack[-1][1] = json.loads(quoted, strict=False)
            wants = "colon"
        elif mark in ("{", "["):
            new = {} if mark == "{" else []
            put(new)
            stack.append([new, None])
            wants, empty = ("key" if mark == "{" else "value"), True
        elif mark is not None:
            raise ValueError(f"no value before {at}")
        else:
            put(json.loads(quoted if quoted is not None else bare, strict=False))
            wants, empty = "more", False
    if text[at:].strip(" \t\n\r") or len(stack) > 1 or len(top) != 1:
        raise ValueError("no whole value")
    return top[0]


def _parsed(text: str):
    """The value that `parse_json` gives; token by token only where it is too deep for the built-in reader."""
    try:
        return json.loads(text, strict=False)
    except RecursionError:
        return parse_json(text)


def _text_or_none(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def list_text_parts(payload: str | None) -> list[dict] | None:
    """The text parts of one payload of any depth, in reading order; none of what is no JSON."""
    return None if payload is None else walk_payload(payload)["leaves"]


def walk_payload(payload: str) -> dict:
    """Headers and text parts of one payload, or why there are none."""
    try:
        whole = _parsed(payload)
    except ValueError:
        return {"headers": None, "leaves": [], "error": NOT_JSON}
    if not isinstance(whole, dict):
        return {"headers": None, "leaves": [], "error": NOT_OBJECT}
    found, waiting = [], [whole]
    while waiting:
        part = waiting.pop()
        if not isinstance(part, dict):
            continue
        body = part.get("body")
        mime, data = part.get("mimeType"), body.get("data") if isinstance(body, dict) else None
        if mime in ("text/plain", "text/html") and isinstance(data, str) and data:
            found.append({"mime": mime, "data": data})
        elif isinstance(part.get("parts"), list):
            waiting.extend(reversed(part["parts"]))
    listed = whole.get("headers")
    headers = [
        {"name": _text_or_none(h.get("name")), "value": _text_or_none(h.get("value"))}
        for h in (listed if isinstance(listed, list) else []) if isinstance(h, dict)
    ]
    return {"headers": headers, "leaves": found, "error": None}


@F.pandas_udf(_WALKED)
def _walk(payloads: pd.Series) -> pd.DataFrame:
    nothing = {"headers": None, "leaves": None, "error": None}
    walked = [nothing if p is None else walk_payload(p) for p in payloads]
    return pd.DataFrame(walked, columns=_WALKED.names, dtype=object)


def _walked(parsed: Column, payload: Column, depth: int) -> Column:
    """The walk of payloads that the schema does not hold whole, null for all others."""
    unread = parsed[_CORRUPT].isNotNull() | (payload.isNotNull() & parsed.isNull())
    return _walk(F.when(unread | _goes_deeper(parsed, depth), payload))


def read_payload(payload: Column, depth: int = DEFAULT_DEPTH) -> Column:
    return F.from_json(payload, payload_schema(depth), {**NO_LIMITS, "columnNameOfCorruptRecord": _CORRUPT})


def text_parts(parsed: Column, payload: Column, depth: int = DEFAULT_DEPTH) -> Column:
    """Text parts of a payload read by `read_payload`, whatever its depth."""
    return F.coalesce(_walked(parsed, payload, depth)["leaves"], _leaves(parsed, depth))


def headers_of(parsed: Column, payload: Column, depth: int = DEFAULT_DEPTH) -> Column:
    """Its headers, also where other fields are not of the schema."""
    return F.coalesce(_walked(parsed, payload, depth)["headers"], parsed["headers"])


def payload_error(parsed: Column, payload: Column, depth: int = DEFAULT_DEPTH) -> Column:
    """Why a payload has no parts to read; null where it is read, or missing."""
    return _walked(parsed, payload, depth)["error"]


def join_text_parts(parts: Column, prefer_plain: bool = False) -> Column:
    """Decoded parts, empty ones left out, one per line.

    With `prefer_plain` the HTML parts count only where there is no plain one.
    """
    if prefer_plain:
        plain = F.filter(parts, lambda p: p["mime"] == "text/plain")
        parts = F.when(F.size(plain) > 0, plain).otherwise(parts)

    def decode(part: Column) -> Column:
        return once(
            decode_utf8(decode_base64url(part["data"])),
            lambda text: F.when(part["mime"] == "text/html", html_to_text(text)).otherwise(text),
        )

    texts = F.filter(F.transform(parts, decode), lambda t: t != "")
    return F.array_join(texts, "\n")

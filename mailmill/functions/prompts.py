"""Inputs of a scorer and its answers, as expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..categories import CATEGORIES
from .text import or_empty

# Longest reason accepted; body length used when candidates are evaluated.
MAX_REASON_CHARS = 80
EVALUATION_BODY_CHARS = 1500

_ANSWER = "category string, reason_short string"
_STRICT = {"allowSingleQuotes": "false"}


def default_instruction(
    categories: Sequence[str] = CATEGORIES, definitions: Mapping[str, str] | None = None,
    demonstrations: Iterable[tuple[str, str]] = (),
) -> str:
    """What a client is told: the categories, what each of them means, messages already sorted.

    A demonstration is the prompt of a message with its category.
    """
    lines = [f"Put the message into exactly one of these categories: {', '.join(categories)}."]
    if definitions:
        lines += ["", *[f"{i}. {c}: {definitions[c]}" for i, c in enumerate(categories, start=1) if c in definitions]]
    for prompt, category in demonstrations:
        lines += ["", prompt, f"Category: {category}"]
    return "\n".join(lines)


def cut_body(body: Column, max_chars: int | None) -> Column:
    """The scorer's view of a body: whole, or its first `max_chars` characters."""
    whole = or_empty(body)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def prompt_text(subject: Column, body: Column, sender: Column | None = None) -> Column:
    parts = [F.lit("Subject: "), or_empty(subject), F.lit("\nBody: "), or_empty(body)]
    if sender is not None:
        parts = [F.lit("From: "), or_empty(sender), F.lit("\n"), *parts]
    return F.concat(*parts)


def chat_messages(instruction: Column, prompt: Column) -> Column:
    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(said("system", instruction), said("user", prompt))


def parse_response(response: Column, categories: tuple[str, ...] = CATEGORIES) -> Column:
    """struct(category, reason) of a JSON answer; both null unless all of it is valid.

    `from_json` would turn a number into text, so the types are checked on the
    raw JSON too. It also stops at the end of the first value: the text is read once
    inside a list and once inside an object, and no text with more behind its
    value passes both.
    """
    listed = F.from_json(F.concat(F.lit("["), response, F.lit("]")), f"array<struct<{_ANSWER}>>", _STRICT)
    answer = F.when(F.size(listed) == 1, F.try_element_at(listed, F.lit(1)))
    category, reason = answer["category"], answer["reason_short"]
    held = F.concat(F.lit('{"a":'), response, F.lit("}"))
    raw = F.from_json(held, "a map<string,variant>", _STRICT)["a"]

    def is_text(field: str) -> Column:
        return F.schema_of_variant(F.try_element_at(raw, F.lit(field))) == "STRING"

    valid = (
        category.isin(list(categories))
        & (F.length(reason) <= MAX_REASON_CHARS)
        & is_text("category")
        & is_text("reason_short")
    )
    return F.struct(
        F.when(valid, category).alias("category"), F.when(valid, reason).alias("reason")
    )

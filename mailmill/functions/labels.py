"""Expressions over arrays of labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..categories import IGNORED_LABELS


def parse_label_text(text: Column) -> Column:
    """A printed Python list of strings to an array; anything else is an empty list."""
    # JSON knows \u00NN but not \xNN. A backslash that is itself escaped starts nothing.
    as_json = F.regexp_replace(
        text, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2"
    )
    is_list = F.startswith(F.ltrim(as_json), F.lit("["))
    # Inside a list of its own, text behind the end of the list is an error.
    wrapped = F.from_json(F.concat(F.lit("["), as_json, F.lit("]")), "array<array<string>>")
    parsed = F.when(is_list & (F.size(wrapped) == 1), F.try_element_at(wrapped, F.lit(1)))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def tag_labels(labels: Column, ignored: Iterable[str] = IGNORED_LABELS) -> Column:
    """Labels outside the ignore list, order and repeats kept."""
    names = list(ignored)
    return F.filter(labels, lambda label: ~label.isin(names))


def main_label(tags: Column) -> Column:
    """The first tag label, or ''."""
    return F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit(""))


def holds_all(label_ids: Column, wanted: Iterable[str]) -> Column:
    ids = F.array(*[F.lit(i) for i in wanted]).cast("array<string>")
    return F.size(F.array_except(ids, or_no_labels(label_ids))) == 0


def holds_any(label_ids: Column, wanted: Iterable[str]) -> Column:
    ids = F.array(*[F.lit(i) for i in wanted]).cast("array<string>")
    return F.arrays_overlap(or_no_labels(label_ids), ids)


def or_no_labels(label_ids: Column) -> Column:
    return F.coalesce(label_ids, F.array().cast("array<string>"))

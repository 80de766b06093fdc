"""Sorts and the most recent messages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAY = 86_400_000_000
# Microseconds of the steps in which the n-th newest moment is closed in on.
_STEPS = (_DAY, _DAY // 24, 60_000_000, 1_000_000, 1_000, 1)
_LETTERS = 2
# So many rows are ranked as they are.
FEW = 10_000


def newest_first(df: DataFrame, ts: str = "internal_ts", key: str = "id") -> DataFrame:
    """Sorted by time, newest first. Sorts on the moment, not on its local text."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(key))


def first_rows(df: DataFrame, n: int, *keys) -> DataFrame:
    return df.orderBy(*keys).limit(n)


class _Edge(NamedTuple):
    """The group of equal leading digits in which the wanted row lies."""

    value: object
    rows: int
    wanted: int


def _edge(rows: DataFrame, digits: Column, wanted: int, newest: bool) -> _Edge | None:
    """Where row number `wanted` lies in the order of `digits`; None where there are fewer rows.

    Rows are counted before the shuffle; the window runs over one row for each group.
    """
    order = F.col("digits").desc() if newest else F.col("digits").asc()
    counts = rows.groupBy(digits.alias("digits")).agg(F.count("*").alias("rows"))
    so_far = F.sum("rows").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("so_far", so_far).where(F.col("so_far") >= wanted)
    first = reached.orderBy("so_far").limit(1).collect()
    if not first:
        return None
    (row,) = first
    return _Edge(row.digits, row.rows, wanted - (row.so_far - row.rows))


def _nth(rows: DataFrame, wanted: int, *order: Column):
    return rows.orderBy(*order).offset(wanted - 1).limit(1).first()


def _nth_key(rows: DataFrame, wanted: int, held: int) -> tuple[str, bool]:
    """Key number `wanted` in order, and whether more rows of that key stand behind it.

    Leading letters are counted, two more in each step, until few rows are left.
    """
    size, longest = 0, None
    while held > FEW:
        size += _LETTERS
        longest = longest or rows.agg(F.max(F.length("key")).alias("longest")).first().longest
        start = F.left("key", F.lit(size))
        edge = _edge(rows, start, wanted, newest=False)
        rows, wanted, held = rows.where(start == edge.value), edge.wanted, edge.rows
        if size >= longest:
            return edge.value, held > wanted
    found = _nth(rows, wanted, F.col("key").asc()).key
    same = rows.where(F.col("key") <= found).count()
    return found, same > wanted


def most_recent(
    df: DataFrame, n: int | None, ts: str = "internal_ts", key: str = "id"
) -> DataFrame:
    """The n newest rows, exactly, sorted; all of them without a limit.

    No task takes n rows. Rows are counted by day, then, within the day of the n-th
    newest one, by hour, minute, second and down to the moment, then by leading letters
    of the key, until few rows are left to rank. The place of the n-th row is then a
    filter that reaches the scan. Undated rows come last, by key. Counting runs while
    the query is built, on the time and the key alone.
    """
    if n is None:
        return newest_first(df, ts, key)
    if n < 1:
        return df.limit(0)
    # The key is compared as text of UTF-8, which is how it is sorted.
    rows = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(key).cast("string").alias("key"))
    place = F.col(key).cast("string")
    dated, edge, inside = rows.where("at is not null"), None, None
    wanted = n
    for step in _STEPS:
        digits = F.floor(F.col("at") / F.lit(step)).cast("long") if step > 1 else F.col("at")
        edge = _edge(dated, digits, wanted, newest=True)
        if edge is None:
            break
        wanted, since = edge.wanted, edge.value * step
        dated = dated.where(F.col("at").between(since, since + step - 1))
        inside = step
        if edge.rows <= FEW:
            break
    if inside is None:
        # Fewer dated rows than wanted: those, and undated ones by key.
        undated = rows.where("at is null")
        counts = rows.agg(F.count("at").alias("dated"), F.count_if(F.col("at").isNull()).alias("undated")).first()
        if counts.dated + counts.undated <= n:
            return newest_first(df, ts, key)
        wanted = n - counts.dated
        if wanted == 0:
            return newest_first(df.where(F.col(ts).isNotNull()), ts, key)
        last, more = _nth_key(undated, wanted, counts.undated)
        kept = df.where(F.col(ts).isNotNull() | (place <= last))
    elif edge.rows <= FEW:
        last_row = _nth(dated, wanted, F.col("at").desc(), F.col("key").asc())
        at, last = last_row.at, last_row.key
        upto = (F.col("at") > at) | ((F.col("at") == at) & (F.col("key") <= last))
        more = dated.where(upto).count() > wanted
        kept = df.where(_from(ts, place, at, last))
    else:
        last, more = _nth_key(dated, wanted, edge.rows)
        kept = df.where(_from(ts, place, edge.value, last))
    found = newest_first(kept, ts, key)
    # Only copies of the last key can be too many.
    return found.limit(n) if more else found


def _from(ts: str, place: Column, at: int, last: str) -> Column:
    """Rows up to the last wanted one. The test on the time alone is one that a scan can use."""
    moment = F.timestamp_micros(F.lit(at))
    return (F.col(ts) >= moment) & ((F.col(ts) > moment) | (place <= last))

"""Lookups of keys of which some are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000
_PLACES = 4096


def lookup(
    df: DataFrame, table: DataFrame, key: list[str], counts: DataFrame, spread: str, hot: int = HOT
) -> DataFrame:
    """`df` with the columns of `table`, null where it has no row; `key` is unique in the table.

    `counts` says in `n` how many rows of `df` have each key. Keys of one row in `hot`
    or more, so at most `hot` of them, are looked up by broadcast, where the rows lie.
    Their rows go through the shuffle join of the others as well, but dealt by
    `spread`, so that no task gets a frequent key. Nothing is copied.
    """
    values = [c for c in table.columns if c not in key]
    total = counts.agg(F.sum("n").alias("n")).scalar()
    frequent = counts.where(F.col("n") * hot >= total).select(*key)
    # At most `hot` rows.
    known = table.join(F.broadcast(frequent), key, "left_semi")
    known = known.select(*key, F.struct(*values).alias("_hot"))
    found = df.join(F.broadcast(known), key, "left")
    place = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(_PLACES))).cast("int")
    rest = table.select(*key, F.lit(0).alias("_place"), F.struct(*values).alias("_cold"))
    joined = found.withColumn("_place", place).join(rest, [*key, "_place"], "left")
    of = F.coalesce("_hot", "_cold")
    return joined.select(*df.columns, *[of[c].alias(c) for c in values])

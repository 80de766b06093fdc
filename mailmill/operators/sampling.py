"""Exact seeded samples and splits, and the latest copy of each message.

Rows are ordered by md5 of id and seed. To take exactly the first k of that
order nothing is sorted as a whole: rows are counted per leading digits of the
hash, the one group of digits in which the k-th row lies is ranked, and the
k-th hash becomes a threshold every row is compared with in the scan stage.
Only counts, and about one row in 4,096, are ever shuffled. The numbers are
exact for unique ids, which `latest_per_id` makes. Where ids repeat, all copies
of the last id taken come along, so that no id is on both sides of a split.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounded import broadcast_if_small

_DIGITS = 3
TRAIN, VAL = "train", "val"


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def _place(df: DataFrame, key: str, seed: int, group: str | None) -> DataFrame:
    """(group, bucket, place): where each row stands in the seeded order."""
    order = seeded_hash(F.col(key), seed)
    return df.select(
        (F.col(group) if group else F.lit(0)).alias("group"),
        F.left(order, F.lit(_DIGITS)).alias("bucket"),
        F.struct(order.alias("hash"), F.col(key).alias("key")).alias("place"),
    )


def _last_places(places: DataFrame, *quotas: Column) -> DataFrame:
    """(group, part, last): the place of row number `quotas[part]` of each group that has that many rows.

    A quota may use `total`, the rows of the group.
    """
    counts = places.groupBy("group", "bucket").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("group")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.posexplode(F.array(*[q.cast("bigint") for q in quotas])).alias("part", "quota")
    edges = (
        counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .withColumn("total", F.sum("rows").over(whole))
        .select("*", parts)
        .withColumn("wanted", F.col("quota") - F.col("before"))
        .where(F.col("wanted").between(1, F.col("rows")))
        .select("group", "bucket", "part", "wanted")
    )
    in_edge = places.join(broadcast_if_small(edges), ["group", "bucket"])
    # Copies of one id are counted before the shuffle, so many of them are one row.
    counted = in_edge.groupBy("group", "bucket", "part", "wanted", "place").agg(F.count("*").alias("copies"))
    so_far = Window.partitionBy("group", "bucket", "part").orderBy("place").rowsBetween(
        Window.unboundedPreceding, 0
    )
    reached = counted.withColumn("reached", F.sum("copies").over(so_far))
    first = (F.col("reached") >= F.col("wanted")) & (
        F.col("reached") - F.col("copies") < F.col("wanted")
    )
    return reached.where(first).select("group", "part", F.col("place").alias("last"))


def stratified_sample(
    df: DataFrame, n: int = 20, seed: int = 42, by: str = "category", key: str = "id"
) -> DataFrame:
    """Exactly min(n, size) rows of each group, without replacement; rows of no group are left out."""
    grouped = df.where(F.col(by).isNotNull())
    if n < 1:
        return grouped.limit(0)
    last = _last_places(_place(grouped, key, seed, by), F.lit(n))
    limits = last.select(F.col("group").alias(by), "last")
    place = F.struct(seeded_hash(F.col(key), seed).alias("hash"), F.col(key).alias("key"))
    # Smaller groups have no limit and are kept whole.
    joined = grouped.join(broadcast_if_small(limits), by, "left")
    return joined.where(F.col("last").isNull() | (place <= F.col("last"))).select(*df.columns)


def train_val_split(
    df: DataFrame, ratio: float = 0.75, seed: int = 42, key: str = "id"
) -> DataFrame:
    """Adds `split`: exactly floor(ratio * rows) rows are train, the rest val."""
    quota = F.floor(F.col("total") * F.lit(ratio))
    last = _last_places(_place(df, key, seed, None), quota)
    # One row, or none when no row is train.
    limit = last.agg(F.max("last").alias("last")).scalar()
    place = F.struct(seeded_hash(F.col(key), seed).alias("hash"), F.col(key).alias("key"))
    return df.withColumn("split", F.when(place <= limit, TRAIN).otherwise(VAL))


def fold_split(df: DataFrame, folds: int = 5, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds `fold`, 0 to `folds` - 1, by the seeded order; sizes differ by one row at most."""
    quotas = [F.ceil(F.col("total") * F.lit(i) / F.lit(folds)) for i in range(1, folds)]
    if not quotas:
        return df.withColumn("fold", F.lit(0))
    last = _last_places(_place(df, key, seed, None), *quotas)
    # One row with the last place of each fold but the last one.
    ends = last.agg(F.struct(*[
        F.max(F.when(F.col("part") == i, F.col("last"))).alias(f"end{i}") for i in range(folds - 1)
    ]).alias("ends")).scalar()
    place = F.struct(seeded_hash(F.col(key), seed).alias("hash"), F.col(key).alias("key"))
    behind = [F.coalesce((place > ends[f"end{i}"]).cast("int"), F.lit(0)) for i in range(folds - 1)]
    return df.withColumn("fold", reduce(add, behind))


def latest_per_id(df: DataFrame, newest: str, *ties: Column, key: str = "id") -> DataFrame:
    """The newest copy of each id; `ties` order copies of the same time, else a hash of the whole row.

    Spark keeps only the first copy of each id within every input partition
    before the shuffle, so an id with very many copies does not gather in one
    task.
    """
    ties = ties or (F.sha2(F.to_json(F.struct(*df.columns)), 256),)
    order = Window.partitionBy(key).orderBy(F.col(newest).desc_nulls_last(), *ties)
    return df.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


# A set that is one list travels whole with every prompt.
MOST_DEMONSTRATIONS = 50


def few_shot_rows(
    examples: DataFrame, sizes: dict[str, int], seed: int = 42
) -> DataFrame:
    """(candidate_id, place, id, category, subject, body_text): demonstrations as rows, of any number.

    Per candidate n train rows of each category, by category and seeded order.
    Candidates draw from one order, so a smaller set is part of a larger one.
    """
    train = examples.where(F.col("split") == TRAIN)
    drawn = stratified_sample(train, max(sizes.values()), seed)
    # The windows run over drawn rows, of which there are n for each category.
    place = Window.partitionBy("category").orderBy(seeded_hash(F.col("id"), seed), "id")
    wanted = F.array(
        *[F.struct(F.lit(c).alias("candidate_id"), F.lit(n).alias("n")) for c, n in sizes.items()]
    )
    rows = drawn.withColumn("_place", F.row_number().over(place)).withColumn("_c", F.explode(wanted))
    rows = rows.where(F.col("_place") <= F.col("_c")["n"]).withColumn("candidate_id", F.col("_c")["candidate_id"])
    order = Window.partitionBy("candidate_id").orderBy("category", "_place")
    return rows.select(
        "candidate_id", (F.row_number().over(order) - 1).alias("place"), "id", "category", "subject", "body_text")


def few_shot_sets(
    examples: DataFrame, sizes: dict[str, int], seed: int = 42
) -> DataFrame:
    """(candidate_id, demonstrations): the rows of `few_shot_rows` as one list for each candidate."""
    if max(sizes.values()) > MOST_DEMONSTRATIONS:
        raise ValueError(f"at most {MOST_DEMONSTRATIONS} demonstrations per category; few_shot_rows has no limit")
    demo = F.struct("place", "id", "category", "subject", "body_text")
    sets = few_shot_rows(examples, sizes, seed).groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(demo)).alias("demonstrations")
    )
    bare = F.transform("demonstrations", lambda d: F.struct(d["id"], d["category"], d["subject"], d["body_text"]))
    return sets.withColumn("demonstrations", bare.cast(
        "array<struct<id:string,category:string,subject:string,body_text:string>>"
    ))
